"""Queries of the image sources (S3, S4) and the image fallback.

The image store is made from ``embeddings``: one small raster a row, its
pixels the vector's components, gray, RGB or RGBA by the row's id.  Some files
are cut short, so that no reader can decode them, and some rows have no file.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepcorpus.plans import stages as G
from stepcorpus.plans import views as V
from stepcorpus.plans.registry import query
from stepcorpus.session import scratch_dir
from stepcorpus.sources import binary_files as FILES
from stepcorpus.sources import files as SRC
from stepcorpus.sources.tables import table

#: By vec_id % 3: gray 8 x 8, RGB 7 x 3, RGBA 4 x 4 of the 64 components (the last is left over for RGB).
WIDTHS, HEIGHTS, CHANNELS = (8, 7, 4), (8, 3, 4), (1, 3, 4)
MISSING, BROKEN = (7, 3), (10, 7)  # vec_id % first = second
CUT = 20  # bytes of a broken file


def _by_kind(values):
    kind = F.col("vec_id") % 3
    return F.when(kind == 0, values[0]).when(kind == 1, values[1]).otherwise(values[2])


def image_store(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """``(root, written files)``: ``img/<vec_id>.png`` for the rows of ``embeddings``."""
    e = table(spark, d, "embeddings").filter(F.col("vec_id") % MISSING[0] != MISSING[1])
    pixels = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 128 + 128))).cast("int"))
    width, height, channels = (_by_kind(v) for v in (WIDTHS, HEIGHTS, CHANNELS))
    image = FILES.png_column(width, height, channels, F.slice(pixels, 1, width * height * channels))
    rows = e.select("vec_id", F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("name"), image.alias("image"))
    content = F.when(F.col("vec_id") % BROKEN[0] == BROKEN[1], F.substring("image", 1, CUT)).otherwise(F.col("image"))
    root = scratch_dir(spark, "images")
    return root, FILES.write_files(rows.withColumn("content", content), root, "name", "content")


def _plain(root: str) -> str:
    return re.sub("^file:(//)?", "", root)


def _vec_id(path: str):
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("long").alias("vec_id")


_W, _H, _C = (f"case vec_id % 3 when 0 then {v[0]} when 1 then {v[1]} else {v[2]} end" for v in (WIDTHS, HEIGHTS, CHANNELS))
_FILES_SQL = f"select vec_id, embedding, {_W} as w, {_H} as h, {_C} as c, vec_id % {BROKEN[0]} = {BROKEN[1]} as broken from embeddings where vec_id % {MISSING[0]} <> {MISSING[1]}"
_HEX = "printf('%02X', greatest(0, least(255, floor(embedding[{}]::double * 128 + 128)))::int)"


@query("s3_read_images", f"""
select vec_id, case when broken then 'invalid' else 'ok' end as status, case when broken then -1 else h end as height, case when broken then -1 else w end as width,
  case when broken then '' else array_to_string([case c when 1 then repeat({_HEX.format('i + 1')}, 3)
    else {_HEX.format('i * c + 1')} || {_HEX.format('i * c + 2')} || {_HEX.format('i * c + 3')} end for i in range(w * h)], '') end as rgb
from ({_FILES_SQL})""")
def s3(spark, d):
    """Images made from the vectors, read back as RGB; those that can't be decoded are kept as invalid."""
    root, _ = image_store(spark, d)
    got = SRC.read_images(spark, root)
    return got.select(_vec_id("path"), "status", "height", "width", F.coalesce(F.hex("rgb"), F.lit("")).alias("rgb"))


@query("s4_image_manifest", f"select 'img/' || vec_id || '.png' as path, case when broken then {CUT} else h * (1 + w * c) + 68 end::bigint as length from ({_FILES_SQL})")
def s4(spark, d):
    """The files of the image store with their lengths, listed without reading them."""
    root, _ = image_store(spark, d)
    listed = SRC.image_manifest(spark, root, "*.png")
    return listed.select(F.substring("path", len(_plain(root)) + 2, 2 ** 31 - 1).alias("path"), "length")


@query("f6_unreadable_images", f"""
select conv_id, case when n < 2 then 'too_few_turns' when i.vec_id is null then 'image_missing' when i.broken then 'image_invalid' else 'ok' end as error_reason,
  (n < 2 or i.vec_id is null or i.broken)::integer as is_fallback
from (select conv_id, count(*) as n from conversations group by conv_id) left join ({_FILES_SQL}) i on i.vec_id = conv_id""")
def f6_images(spark, d):
    """Stage-1 samples against the image store: missing and unreadable images give the fallback sample, no row goes."""
    root, _ = image_store(spark, d)
    manifest = SRC.read_images(spark, root).select("path", "status")
    s = G.stage1_tokens(V.conv_nested(spark, d), _plain(root), manifest)
    return s.select("conv_id", F.coalesce("error_reason", F.lit("ok")).alias("error_reason"), F.col("is_fallback").cast("int").alias("is_fallback"))
