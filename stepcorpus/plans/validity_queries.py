"""Queries for F1-F6: first-n, validity, report, spot check, fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.operators import validity as VA
from stepcorpus.plans import stages as G
from stepcorpus.plans import views as V
from stepcorpus.plans.oracle_views import STAGE_IMAGE_ROOT, q, resolve_sql, with_views
from stepcorpus.plans.registry import query, sql_join
from stepcorpus.sources.first_records import first_rows


FIRST_N = 300  # max_samples for the F1 query


@query("f1_first_n", f"select conv_id, turn, role, text from conversations order by conv_id, turn limit {FIRST_N}")
def f1(spark, d):
    """The first 300 rows of the conversations file, in file order."""
    return first_rows(spark, f"{d.rstrip('/')}/conversations.parquet", FIRST_N).select("conv_id", "turn", "role", "text")


@query("f2_has_image_url", with_views(["step_records"], """
select conv_id, image_url from step_records where coalesce(image_url, '') <> ''"""))
def f2(spark, d):
    """Records with a non-empty image URL."""
    return VA.has_image_url(V.step_records(spark, d)).select("conv_id", "image_url")


_RESOLVED = resolve_sql("image_url", V.IMAGE_BASE)


@query("f3_image_exists", with_views(["step_records", "manifest"], f"""
select conv_id, {_RESOLVED} as full_image_path from step_records
where coalesce(image_url, '') <> '' and {_RESOLVED} in (select path from manifest)"""))
def f3(spark, d):
    """Records whose resolved image is in the manifest (semi join)."""
    r = VA.has_image_url(V.step_records(spark, d))
    return VA.image_exists(r, V.manifest(spark, d), V.IMAGE_BASE).select("conv_id", "full_image_path")


@query("f4_validity_report", with_views(["step_records", "manifest"], f"""
select count(*) as total, count(*) filter (where reason = 'valid') as valid,
  count(*) filter (where reason <> 'valid') as invalid,
  count(*) filter (where reason = 'no_image_url') as no_image_url,
  count(*) filter (where reason = 'image_missing') as image_missing
from (select case when coalesce(image_url, '') = '' then 'no_image_url'
                  when {_RESOLVED} not in (select path from manifest) then 'image_missing' else 'valid' end as reason
      from step_records)"""))
def f4(spark, d):
    """Total / valid / invalid counts with reasons for the stage-3 records."""
    reasons = VA.validity_reasons(V.step_records(spark, d), V.manifest(spark, d), V.IMAGE_BASE)
    return VA.validity_report(reasons)


@query("f5_path_spot_check", with_views(["conv_nested", "manifest"], f"""
select s.conv_id, s.path, cast(m.path is not null as integer) as exists
from (select conv_id, {sql_join(q(STAGE_IMAGE_ROOT), 'image')} as path from conv_nested
      order by md5('42:' || conv_id), conv_id limit 5) s left join manifest m on m.path = s.path"""))
def f5(spark, d):
    """Five seeded random records with their image path, marked exists/missing."""
    c = V.conv_nested(spark, d)
    return VA.path_spot_check(c, T.join_path_lit(STAGE_IMAGE_ROOT, F.col("image")), V.manifest(spark, d),
                              "conv_id", k=5, seed=42)


@query("f6_with_fallback", with_views(["stage2_long", "stage2_err"], f"""
select e.conv_id, coalesce(e.err, 'ok') as error_reason, cast(e.err is not null as integer) as is_fallback,
  count(*) as n_input, count(*) filter (where l.label_tok <> {q(S.PAD_TOKEN)}) as n_supervised
from stage2_err e join stage2_long l using (conv_id) group by e.conv_id, e.err"""))
def f6(spark, d):
    """Stage-2 samples per conversation: bad rows replaced by the fallback, never dropped."""
    s = G.stage2_tokens(V.conv_nested(spark, d), STAGE_IMAGE_ROOT, V.manifest(spark, d))
    s = G.stage2_labels(s, "tokens", F.lit(S.PAD_TOKEN))
    return s.select("conv_id", F.coalesce("error_reason", F.lit("ok")).alias("error_reason"),
                    F.col("is_fallback").cast("int").alias("is_fallback"),
                    F.size("input").cast("bigint").alias("n_input"),
                    F.size(F.filter("labels", lambda t: t != F.lit(S.PAD_TOKEN))).cast("bigint").alias("n_supervised"))
