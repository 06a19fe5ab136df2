"""F1 on files: the first n records in file order, without reading the files behind them.

Files are taken in the order of their paths.  A first phase counts records,
file by file at first and then in batches that double, until n is reached;
it reads no column of a columnar file, and of JSONL it parses lines but
keeps none.  The second phase reads only the files up to the one that holds
record n; all but that last one are taken whole.  In the last file a running
count over its splits finds the split of record n, and the records up to it are
kept by place.  Files that are not needed are never opened by the second
phase, and by the first only those of the last batch.

n counts records before any validity check.  ``None`` and 0 keep all; with
fewer than n records all are kept; a negative n raises.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepcorpus.operators.validity import first_n, with_file_order
from stepcorpus.session import materialize
from stepcorpus.sources.files import QUARANTINE_CHARS, STEP_RECORD_SCHEMA, checked_lines

MOST_AT_ONCE = 1024  # files counted in one job


def _plain(file: str) -> str:
    """A listed file as a path to read: no URL escapes, no pattern characters."""
    return "".join(f"[{c}]" if c in "[{*?" else f"\\{c}" if c in "]}\\" else c for c in unquote(file))


def needed_files(files: list[str], counts: Callable[[list[str]], dict[str, int]], n: int) -> tuple[list[str], int]:
    """``(files up to the one with record n, records before the last of them)``; ``counts`` counts a batch."""
    before, at, batch, last = 0, 0, 1, 0
    while at < len(files):
        if at == len(files) - 1:  # whatever it holds, it is the last one needed
            return files, before
        group = files[at:at + batch]
        found = counts(group)
        if unknown := set(found) - set(group):
            raise ValueError(f"files listed under other names: {sorted(unknown)[:3]}")
        for i, file in enumerate(group):
            last = found.get(file, 0)
            if before + last >= n:
                return files[:at + i + 1], before
            before += last
        at, batch = at + batch, min(2 * batch, MOST_AT_ONCE)
    return files, before - last


def _named(file: str) -> str:
    """One form of a local file's name: listings write ``file:///a``, scans ``file:/a``."""
    return re.sub("^file:/+", "file:///", file)


def _by_file(rows: DataFrame) -> dict[str, int]:
    """Records by file; a row for each file of one batch reaches the driver."""
    return {_named(r["_file"]): r["count"] for r in rows.groupBy("_file").count().collect()}


def _listed(df: DataFrame) -> list[str]:
    return sorted(map(_named, df.inputFiles()))


def first_rows(spark: SparkSession, path: str, n: int | None, file_format: str = "parquet") -> DataFrame:
    """the first n rows of the files below ``path``."""
    if n is not None and n < 0:
        raise ValueError("first_n needs n >= 0 (a negative count would cut from the end)")
    whole = spark.read.format(file_format).load(path)
    if not n:
        return whole
    read = lambda files: spark.read.format(file_format).schema(whole.schema).load([_plain(f) for f in files])
    files, before = needed_files(_listed(whole), lambda fs: _by_file(read(fs).select(F.col("_metadata.file_path").alias("_file"))), n)
    if not files:
        return whole
    last = first_n(read(files[-1:]), n - before)
    return read(files[:-1]).unionByName(last) if len(files) > 1 else last


def _cut(good: DataFrame, n: int) -> DataFrame:
    """The first n of one file's good lines, by split and place."""
    places = materialize(good.select("_block", "_mid"), "places")
    before = F.coalesce(F.sum("count").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a split
    split = places.groupBy("_block").count().withColumn("before", before).filter((F.col("before") < n) & (F.col("before") + F.col("count") >= n)).first()
    if split is None:
        return good
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("_mid"))  # one split's lines
    at = places.filter(F.col("_block") == split["_block"]).withColumn("rank", rank).filter(F.col("rank") == n - split["before"]).first()["_mid"]
    return good.filter((F.col("_block") < split["_block"]) | ((F.col("_block") == split["_block"]) & (F.col("_mid") <= at)))


def first_step_records(spark: SparkSession, path: str, n: int | None, schema: T.StructType = STEP_RECORD_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """S2 with F1: ``(good, quarantine)`` of the first n parsed records of JSONL files; the quarantine holds the
    bad lines of the files that were read."""
    if n is not None and n < 0:
        raise ValueError("first_n must be >= 0")
    checked = lambda files: checked_lines(with_file_order(spark.read.text(files)), schema)
    good = lambda df: df.filter(F.col("reason").isNull())
    files, before = _listed(spark.read.text(path)), 0
    if n:
        files, before = needed_files(files, lambda fs: _by_file(good(checked([_plain(f) for f in fs])).select("_file")), n)
    paths = [_plain(f) for f in files] or path
    columns = [*[F.col("_r")[f.name].alias(f.name) for f in schema.fields], "instruction_present", "_file", "_block", "_mid"]
    quarantine = checked(paths).filter(F.col("reason").isNotNull()).select(F.col("value").alias("line"), F.substring("value", 1, QUARANTINE_CHARS).alias("head"), "reason", "_file")
    if not n or not files:
        return good(checked(paths)).select(*columns), quarantine
    records = _cut(good(checked(paths[-1:])).select(*columns), n - before)
    return good(checked(paths[:-1])).select(*columns).unionByName(records) if len(paths) > 1 else records, quarantine
