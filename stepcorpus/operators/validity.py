"""First-n in file order, validity checks, report, spot check, fallback.

Bad rows are flagged, not silently lost: the filters here have a ``reject``
twin (``left_anti``) and the report counts every reason, so
valid + invalid = total always holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepcorpus.functions.ranking import seeded_key
from stepcorpus.operators.prompts import resolve_image_path
from stepcorpus.session import broadcast_if_small


def with_file_order(df: DataFrame) -> DataFrame:
    """Tag rows of a file scan with ``(_file, _block, _mid)``: the file, the
    split's start offset and a within-task running id.  Rows of one split are
    read in file order, so ``_mid`` grows with the line/row position."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_mid"))


def first_n(df: DataFrame, n: int | None) -> DataFrame:
    """the first n rows in file order (files by path, then position),
    taken **before** any validity check.  ``None``/0 keeps all rows.

    No sort and no single-task limit: each split's row count and first id
    form a small table (one row per input split, i.e. bytes / split size),
    whose running sum gives every split's offset; a row is kept when
    offset + position < n.  That table is broadcast only after its row
    count is checked; beyond the bound it is shuffle-joined.
    """
    if n is None or n == 0:
        return df
    if n < 0:
        raise ValueError("first_n needs n >= 0 (a negative count would cut from the end)")
    t = with_file_order(df)
    splits = t.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", "_m0", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    splits, _ = broadcast_if_small(splits)
    kept = (t.join(splits, ["_file", "_block"])
            .filter(F.col("_off") + F.col("_mid") - F.col("_m0") < F.lit(n)))
    return kept.select(*df.columns)


def has_image_url(df: DataFrame, url: str = "image_url") -> DataFrame:
    """drop rows whose URL is null or empty (see ``validity_report``)."""
    return df.filter(F.coalesce(F.col(url), F.lit("")) != F.lit(""))


def image_exists(df: DataFrame, manifest: DataFrame, base: str, url: str = "image_url",
                 keep_missing: bool = False) -> DataFrame:
    """resolve the URL (P3) and keep rows whose file is in the manifest.
    The manifest is one row per file; AQE broadcasts it when small."""
    resolved = df.withColumn("full_image_path", resolve_image_path(F.col(url), base))
    files = manifest.select(F.col("path").alias("full_image_path"))
    return resolved.join(files, "full_image_path", "left_anti" if keep_missing else "left_semi")


def image_readable(manifest: DataFrame) -> Column:
    """Whether a listed image could be read: by ``status`` (as ``read_images`` gives it), or every one."""
    return F.col("status") != F.lit("invalid") if "status" in manifest.columns else F.lit(True)


def validity_reasons(df: DataFrame, manifest: DataFrame, base: str, url: str = "image_url") -> DataFrame:
    """Every record with ``reason`` in (``valid``, ``no_image_url``, ``image_missing``); a file that
    can't be read exists, so its record is valid and takes the stage's fallback later."""
    resolved = df.withColumn("full_image_path", resolve_image_path(F.col(url), base))
    files = manifest.select(F.col("path").alias("_mpath"), F.lit(True).alias("_exists"))
    j = resolved.join(files, F.col("full_image_path") == F.col("_mpath"), "left")
    reason = (F.when(F.coalesce(F.col(url), F.lit("")) == F.lit(""), F.lit("no_image_url"))
              .when(F.col("_exists").isNull(), F.lit("image_missing")).otherwise(F.lit("valid")))
    return j.withColumn("reason", reason).drop("_mpath", "_exists")


def validity_report(reasons: DataFrame) -> DataFrame:
    """one row of counts; ``valid + invalid = total``."""
    r = F.col("reason")
    return reasons.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(r == "valid", 1)).alias("valid"),
        F.count(F.when(r != "valid", 1)).alias("invalid"),
        F.count(F.when(r == "no_image_url", 1)).alias("no_image_url"),
        F.count(F.when(r == "image_missing", 1)).alias("image_missing"))


def path_spot_check(df: DataFrame, path: Column, manifest: DataFrame, key: str, k: int = 5,
                    seed: int = 42) -> DataFrame:
    """min(k, n) rows chosen by a seeded hash, each marked exists/missing.
    k is small by design (a log check), so ``orderBy().limit(k)`` keeps k rows
    per task and merges them."""
    picked = (df.select(key, path.alias("path"), seeded_key(seed, key).alias("_h"))
              .orderBy("_h", key).limit(k))
    files = manifest.select("path", F.lit(1).alias("_e"))
    return (picked.join(files, "path", "left")
            .select(key, "path", F.coalesce("_e", F.lit(0)).alias("exists")))
