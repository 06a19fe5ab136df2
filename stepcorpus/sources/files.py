"""Conversation JSON arrays, step JSONL, images, image listings, sample sink.

* JSON-array files are one document per file.  ``json_arrays`` reads large
  ones by byte ranges; ``read_conversations`` is the plain reader, one task a
  file.  JSONL is read as text (splittable) and parsed per line.
* Bad JSONL lines go to a quarantine with their first 100 characters and a
  reason; the job goes on, as the training script does.
* Images come from Spark's ``image`` source; its BGR(A)/gray buffers are
  turned into RGB in ``mapInPandas``.  Listings use ``binaryFile`` without
  reading the file contents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepcorpus import settings as S
from stepcorpus.functions.ranking import with_global_rank
from stepcorpus.operators.validity import with_file_order


CONVERSATION_SCHEMA = T.StructType([
    T.StructField("image", T.StringType()),
    T.StructField("conversations", T.ArrayType(T.StructType([
        T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]))),
])

STEP_RECORD_SCHEMA = T.StructType([
    T.StructField("image_url", T.StringType()),
    T.StructField("instruction", T.StringType()),
])

QUARANTINE_CHARS = 100


# ------------------------------------------------------------------------ S1

def read_conversations(spark: SparkSession, path: str, schema: T.StructType = CONVERSATION_SCHEMA) -> DataFrame:
    """Files that each hold one JSON array of conversation records."""
    return spark.read.schema(schema).option("multiLine", True).option("encoding", "UTF-8").json(path)


def write_conversations(df: DataFrame, path: str, key: str, rows_per_file: int = 1000) -> None:
    """The JSON-array layout for a conversation table: rows are hashed into
    ``ceil(n / rows_per_file)`` buckets and every bucket becomes one file
    holding one array (a bucket is one row of text, and a file takes one row)."""
    n = df.count()
    buckets = max(1, -(-n // rows_per_file))
    rec = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    files = (df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.struct(key, rec.alias("j")).alias("r"))
             .groupBy("bucket")
             .agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("r")),
                                                                  lambda x: x["j"]), ","), F.lit("]")).alias("value")))
    files.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def conversations_to_parquet(spark: SparkSession, src: str, dst: str) -> None:
    """Read the JSON arrays once, by byte ranges, and keep them as Parquet for every later job."""
    from stepcorpus.sources.json_arrays import read_array_files
    read_array_files(spark, src, CONVERSATION_SCHEMA).write.mode("overwrite").parquet(dst)


# ------------------------------------------------------------------------ S2

def _strict_check(line: str | None) -> tuple[str | None, list[str] | None]:
    if line is None or not line.strip():
        return "blank", None
    try:
        obj = json.loads(line)
    except ValueError:
        return "parse_error", None
    if not isinstance(obj, dict):
        return "not_object", None
    return None, list(obj.keys())


@F.pandas_udf(T.StructType([T.StructField("reason", T.StringType()),
                            T.StructField("keys", T.ArrayType(T.StringType()))]))
def strict_json_check(lines: pd.Series) -> pd.DataFrame:
    """Python's own ``json`` verdict per line: null ``reason`` for one JSON
    object (then ``keys`` are its keys), else why the line is rejected.
    Spark's parser alone accepts trailing text and rejects NaN, so the
    strict check stays in Python; it runs once per line in Arrow batches."""
    out = [_strict_check(v) for v in lines]
    return pd.DataFrame({"reason": [r for r, _ in out], "keys": [k for _, k in out]})


# Not repeatable to the optimizer, so that a line is checked once where the
# verdict is both filtered on and read.
strict_json_check = strict_json_check.asNondeterministic()
CORRUPT = "_corrupt"


def checked_lines(lines: DataFrame, schema: T.StructType, line: str = "value") -> DataFrame:
    """``lines`` with ``_r`` (the parsed record), ``reason`` (null for a good
    line) and ``instruction_present``.  A line that Python accepts and Spark's
    parser can't read under ``schema`` has the reason ``not_readable``."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(line, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = lines.withColumn("_chk", strict_json_check(F.col(line))).withColumn("_r", parsed)
    return out.withColumns({
        "reason": F.coalesce(F.col("_chk.reason"), F.when(F.col("_r")[CORRUPT].isNotNull(), F.lit("not_readable"))),
        "instruction_present": F.coalesce(F.array_contains(F.col("_chk.keys"), F.lit("instruction")), F.lit(False))}).drop("_chk")


def read_step_jsonl(spark: SparkSession, path: str, schema: T.StructType = STEP_RECORD_SCHEMA,
                    first_n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """S2 (+ F1): parse one JSON object per line.

    Returns ``(good, quarantine)``.  ``good`` has the schema's columns plus
    ``instruction_present`` (the key exists, even if null) and the file order
    key; ``quarantine`` has the whole ``line``, its ``head`` (100 characters, as logged) and ``reason``.
    With ``first_n`` only the first n parsed records in file order are kept,
    before any validity check, like ``max_samples``.
    """
    raw = with_file_order(spark.read.text(path))
    checked = checked_lines(raw, schema)
    quarantine = checked.filter(F.col("reason").isNotNull()).select(
        F.col("value").alias("line"), F.substring("value", 1, QUARANTINE_CHARS).alias("head"), "reason", "_file")
    good = checked.filter(F.col("reason").isNull()).select(
        *[F.col("_r")[f.name].alias(f.name) for f in schema.fields], "instruction_present", "_file", "_block", "_mid")
    if first_n:
        if first_n < 0:
            raise ValueError("first_n must be >= 0")
        good = (with_global_rank(good, [F.col("_file"), F.col("_block"), F.col("_mid")], "_order")
                .filter(F.col("_order") <= first_n))
    return good, quarantine


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line (null fields are left out, like a missing key)."""
    df.write.mode("overwrite").json(path)


# ------------------------------------------------------------------------ S3

IMAGE_OUT_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("rgb", T.BinaryType()),
])


def _to_rgb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = {"path": [], "status": [], "height": [], "width": [], "rgb": []}
        for origin, h, w, ch, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
            out["path"].append(origin)
            if h is None or h < 0 or data is None or len(data) == 0:
                out["status"].append("invalid")
                out["height"].append(-1)
                out["width"].append(-1)
                out["rgb"].append(None)
                continue
            a = np.frombuffer(bytes(data), dtype=np.uint8).reshape(int(h), int(w), int(ch))
            if ch == 1:
                rgb = np.repeat(a, 3, axis=2)
            else:  # Spark stores BGR / BGRA
                rgb = a[:, :, 2::-1]
            out["status"].append("ok")
            out["height"].append(int(h))
            out["width"].append(int(w))
            out["rgb"].append(np.ascontiguousarray(rgb).tobytes())
        yield pd.DataFrame(out)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """S3: every image below ``root`` decoded to 8-bit RGB (row-major, HxWx3).
    An unreadable file is kept with ``status = 'invalid'`` (its sample then
    falls back to a white image)."""
    img = (spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True)
           .load(root).select("image.*"))
    out = img.mapInPandas(_to_rgb, IMAGE_OUT_SCHEMA)
    return out.withColumn("path", normalize_path(F.col("path")))


def fallback_image() -> bytes:
    """The white 224x224 RGB image used when an image cannot be loaded."""
    return bytes([255]) * (S.FALLBACK_IMAGE_SIZE * S.FALLBACK_IMAGE_SIZE * 3)


# ------------------------------------------------------------------------ S4

def normalize_path(p):
    """Drop the ``file:`` scheme so listed paths compare with plain paths."""
    return F.regexp_replace(p, "^file:(//)?", "")


def image_manifest(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """The set of files below ``root`` as ``(path, length)``; the file
    contents are not read (``content`` is pruned from the scan)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(root).select(normalize_path(F.col("path")).alias("path"), "length")


# ------------------------------------------------------------------------ S5

def write_samples(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("split",)) -> None:
    """Hand prepared samples to the trainer as Parquet, one folder per split."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def write_balanced_shards(df: DataFrame, path: str, key: str, n_tokens: str, shard_tokens: int, seed: int = 42) -> DataFrame:
    """S5 for many trainers: samples as Parquet in one folder a shard, of equal token counts
    (``batches.token_shards``), in their seeded order.  Returns what ``shard_manifest`` finds in the files."""
    from stepcorpus.operators.batches import token_shards
    placed = df.join(token_shards(df, key, n_tokens, shard_tokens, seed), key)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartition(n, "shard").sortWithinPartitions("shard", "before").write.mode("overwrite").partitionBy("shard").parquet(path)
    return shard_manifest(df.sparkSession, path, key, n_tokens)


def shard_manifest(spark: SparkSession, path: str, key: str, n_tokens: str) -> DataFrame:
    """shard, n_rows, n_tokens, first_token, checksum (the sum of 32 bits of every row's md5 of key and count) of
    written shards, as read from their files."""
    rows = spark.read.parquet(path)
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col(n_tokens).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(n_tokens).cast("long").alias("n_tokens"), F.min("before").alias("first_token"), F.sum(digest).alias("checksum"))
