"""End-to-end stage queries: the samples the three trainers consume, as ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions.arrays import explode_rows
from stepcorpus.operators import batches as B
from stepcorpus.operators import tokens as K
from stepcorpus.plans import stages as G
from stepcorpus.plans import views as V
from stepcorpus.plans.oracle_views import STAGE_IMAGE_ROOT, q, vocab_sql, with_views
from stepcorpus.plans.registry import query
from stepcorpus.session import materialize


def pad_id():
    """Id of the pad token (the first special token)."""
    return F.lit(0).cast("bigint")


def _long(df, key: str):
    z = F.arrays_zip(F.col("input").alias("i"), F.col("labels").alias("l"))
    return (explode_rows(df, z, [key], "pos", "z")
            .select(key, F.col("pos").cast("bigint").alias("pos"), F.col("z.i").alias("input_id"),
                    F.col("z.l").alias("label")))


def stage1_samples(spark, d):
    s = materialize(G.stage1_tokens(V.conv_nested(spark, d), STAGE_IMAGE_ROOT, V.manifest(spark, d)))
    vocab = K.build_vocab(s, "tokens")
    enc = G.encode_stage(s, vocab)
    return G.stage1_labels(enc, "ids", pad_id())


_STAGE1_LONG = """
select l.conv_id, l.pos, v.token_id as input_id,
  case when l.pos + 1 < l.n_prompt then 0 else v2.token_id end as label
from (select conv_id, n_prompt, unnest(range(len(tokens) - 1)) as pos,
        unnest(list_slice(tokens, 1, len(tokens) - 1)) as tok, unnest(list_slice(tokens, 2, len(tokens))) as next_tok
      from stage1_tokens) l
join vocab v on v.token = l.tok join vocab v2 on v2.token = l.next_tok"""
_STAGE1_VOCAB = ("vocab", vocab_sql("select unnest(tokens) as token from stage1_tokens"))


@query("stage1_samples", with_views(["stage1_tokens"], _STAGE1_LONG, [_STAGE1_VOCAB]))
def q_stage1(spark, d):
    """Stage-1 (pretraining) samples: ids and prefix-masked, shifted labels."""
    return _long(stage1_samples(spark, d), "conv_id")


def stage2_samples(spark, d, sf_conv=None):
    s = materialize(G.stage2_tokens(sf_conv if sf_conv is not None else V.conv_nested(spark, d),
                                    STAGE_IMAGE_ROOT, V.manifest(spark, d)))
    vocab = K.build_vocab(s, "tokens")
    enc = G.encode_stage(s, vocab)
    return G.stage2_labels(enc, "ids", pad_id())


_STAGE2_LONG = """
select l.conv_id, l.pos, v.token_id as input_id, v2.token_id as label
from stage2_long l join vocab v on v.token = l.input_tok join vocab v2 on v2.token = l.label_tok"""
_STAGE2_VOCAB = ("vocab", vocab_sql("select tok as token from stage2_full"))


@query("stage2_samples", with_views(["stage2_long", "stage2_full"], _STAGE2_LONG, [_STAGE2_VOCAB]))
def q_stage2(spark, d):
    """Stage-2 (fine-tuning) samples: ids and assistant-span labels, shifted."""
    return _long(stage2_samples(spark, d), "conv_id")


def id_batches(samples, stage):
    """B3 on a stage's samples: ids and labels in batches of the stage's size, padded with the pad id to the longest
    of the batch.  The lengths travel with the narrow assignment, so the arrays meet it in one join."""
    written = materialize(samples.select("conv_id", "input", "labels"), "samples")
    batches = B.assign_batches(written, "conv_id", stage.batch_size, 1, S.STAGE3.seed, length_of="input")
    return B.pad_to_batch_max(batches, {"input": pad_id(), "labels": pad_id()}, "input", max_len="max_len")


def _batch_long(batches):
    z = F.arrays_zip(F.col("input").alias("i"), F.col("labels").alias("l"))
    return (explode_rows(batches, z, ["batch_id", "slot", "conv_id"], "pos", "z")
            .select("batch_id", "slot", "conv_id", F.col("pos").cast("bigint").alias("pos"), F.col("z.i").alias("input_id"), F.col("z.l").alias("label")))


def _batch_sql(stage) -> str:
    return f"""
select p.batch_id, p.slot, p.conv_id, p.pos, coalesce(s.input_id, 0) as input_id, coalesce(s.label, 0) as label
from (select batch_id, slot, conv_id, unnest(range(max_len)) as pos from (
  select conv_id, cast((rk - 1) // {stage.batch_size} as bigint) as batch_id, cast((rk - 1) % {stage.batch_size} as integer) as slot,
    max(n) over (partition by (rk - 1) // {stage.batch_size}) as max_len
  from (select conv_id, count(*) as n, row_number() over (order by md5('{S.STAGE3.seed}:0:' || conv_id), conv_id) as rk from samples group by conv_id))) p
left join samples s on s.conv_id = p.conv_id and s.pos = p.pos"""


@query("b3_stage1_batches", with_views(["stage1_tokens"], _batch_sql(S.STAGE1), [_STAGE1_VOCAB, ("samples", _STAGE1_LONG)]))
def q_stage1_batches(spark, d):
    """Stage-1 samples as padded id batches of 16."""
    return _batch_long(id_batches(stage1_samples(spark, d), S.STAGE1))


@query("b3_stage2_batches", with_views(["stage2_long", "stage2_full"], _batch_sql(S.STAGE2), [_STAGE2_VOCAB, ("samples", _STAGE2_LONG)]))
def q_stage2_batches(spark, d):
    """Stage-2 samples as padded id batches of 4."""
    return _batch_long(id_batches(stage2_samples(spark, d), S.STAGE2))


def stage2_summary(spark, d):
    """Per conversation: fallback flag, input length and supervised positions."""
    s = stage2_samples(spark, d)
    return s.select("conv_id", F.coalesce("error_reason", F.lit("ok")).alias("error_reason"),
                    F.col("is_fallback").cast("int").alias("is_fallback"),
                    F.size("input").cast("bigint").alias("n_input"),
                    F.size(F.filter("labels", lambda t: t != pad_id())).cast("bigint").alias("n_supervised"))


@query("stage2_summary", with_views(["stage2_long", "stage2_err"], f"""
select e.conv_id, coalesce(e.err, 'ok') as error_reason, cast(e.err is not null as integer) as is_fallback,
  count(*) as n_input, count(*) filter (where l.label_tok <> {q(S.PAD_TOKEN)}) as n_supervised
from stage2_err e join stage2_long l using (conv_id) group by e.conv_id, e.err"""))
def q_stage2_summary(spark, d):
    """Stage-2 per-conversation summary in ids (the flagship query)."""
    return stage2_summary(spark, d)


def stage3_sample_rows(spark, d):
    """Stage-3 samples of both splits: ids, labels and step lists of every valid record."""
    valid = G.stage3_valid(V.step_records_full(spark, d), V.manifest(spark, d), V.IMAGE_BASE)
    toks = materialize(G.stage3_tokens(valid), "stage3-tokens")
    enc = G.encode_stage(toks, K.build_vocab(toks, "tokens")).select("conv_id", "ids", K.clone_labels(F.col("ids")).alias("labels"), "steps")
    return B.exact_split(enc, "conv_id", S.STAGE3.val_fraction, S.STAGE3.seed).select("conv_id", "split", "ids", "labels", "steps")


def stage3_long(samples):
    """One row per token (``n``: position, ``value``: id) and per step (``n``: step number, ``value``: step index)."""
    z = F.arrays_zip(F.col("ids").alias("i"), F.col("labels").alias("l"))
    big = lambda c: F.col(c).cast("bigint")
    written = materialize(samples, "stage3-samples")
    toks = explode_rows(written, z, ["conv_id", "split"], "pos", "z").select(
        "conv_id", "split", F.lit("token").alias("part"), big("pos").alias("n"), big("z.i").alias("value"), big("z.l").alias("label"))
    steps = explode_rows(written, "steps", ["conv_id", "split"], value="s").select(
        "conv_id", "split", F.lit("step").alias("part"), big("s.step_no").alias("n"), big("s.token_idx").alias("value"), big("s.label").alias("label"))
    return toks.unionByName(steps)


@query("stage3_samples", with_views(["stage3_split", "stage3_ids", "stage3_steps"], """
select conv_id, split, 'token' as part, cast(pos as bigint) as n, cast(token_id as bigint) as value, cast(token_id as bigint) as label
from stage3_ids join stage3_split using (conv_id)
union all
select conv_id, split, 'step' as part, cast(step_no as bigint) as n, cast(token_idx as bigint) as value, cast(label as bigint) as label
from stage3_steps join stage3_split using (conv_id)"""))
def q_stage3(spark, d):
    """Stage-3 (verifier) samples of both splits: ids, labels, step indices and verification labels."""
    return stage3_long(stage3_sample_rows(spark, d))
