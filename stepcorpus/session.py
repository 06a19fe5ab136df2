"""Spark session and shared scratch location.

On a cluster the session comes from the caller; nothing here overrides
settings that are already present.  ``scratch_dir`` reads the shared folder
named by ``spark.checkpoint.dir`` and only creates a local one when the
setting is missing (tests, single-machine runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stepcorpus",
                driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark (a cluster passes its own)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in {**_LOCAL_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return spark.sparkContext.getCheckpointDir() or conf_dir
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="stepcorpus-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SCOPES: list[list[str]] = []


@contextmanager
def written_tables(spark: SparkSession):
    """Tables that ``materialize`` writes inside this scope are deleted at its
    end, so results that still read them must be written before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _SCOPES.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df, name: str = "materialized"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a DataFrame that reads it back.  Later branches read the table
    instead of recomputing its lineage (a reliable RDD checkpoint would
    compute an unpersisted input twice), and a lost executor does not send
    the job back to the source."""
    path = scratch_dir(df.sparkSession, name)
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# A lookup side is broadcast only when its counted rows and bytes are at most
# these (a tokenizer vocabulary is ~1e5-1e6 rows of a few bytes).  Larger
# sides use a shuffle join.
BROADCAST_MAX_ROWS = 4_000_000
BROADCAST_MAX_BYTES = 256 << 20
ROW_BYTES = 16  # of the fixed-width part of a row


def broadcast_if_small(df, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES):
    """``(df, small)``: ``df`` marked for broadcast if its counted rows and bytes
    allow it; otherwise the join is left to a shuffle (with AQE splitting
    skewed partitions).  Meant for materialized tables of narrow rows."""
    from pyspark.sql import functions as F
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("bigint") for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0).cast("bigint"))), F.lit(0))).first()
    small = n <= max_rows and size + ROW_BYTES * n <= max_bytes
    return (F.broadcast(df), True) if small else (df, False)


BATCH_BYTES = 4 << 20  # of rows that a task hands to Python at once


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about ``BATCH_BYTES``, unless the session asks
    for less.  Spark's bound of 10,000 rows alone makes batches of tens of
    megabytes out of whole texts, which each task's Python worker holds
    beside what it makes of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if bound <= 0 or bound > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``stepcorpus`` importable in the Python workers (as
    ``--py-files`` would): zip the package once per application and
    register it with ``addPyFile``.  Needed wherever a pandas UDF or
    ``mapInPandas`` function from this package runs on executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import stepcorpus
    pkg_dir = os.path.dirname(os.path.abspath(stepcorpus.__file__))
    root = os.path.dirname(pkg_dir)
    base = ensure_checkpoint_dir(spark)
    local_base = base[len("file:"):] if base.startswith("file:") else base
    if "://" in local_base or not os.path.isdir(local_base):
        local_base = tempfile.mkdtemp(prefix="stepcorpus-pyfiles-")  # staged on the driver only
    path = os.path.join(local_base, f"stepcorpus-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
