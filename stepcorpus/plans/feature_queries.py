"""Queries for J1-J7: embeddings lookup, feature scatter, pooling, projection, gather."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.functions.arrays import explode_rows
from stepcorpus.operators import features as J
from stepcorpus.operators import tokens as K
from stepcorpus.operators.prompts import stage3_prompt_prefix
from stepcorpus.plans import stages as G
from stepcorpus.plans import views as V
from stepcorpus.plans.oracle_views import STEP_RE, TOKEN_RE, q, sql_text, vocab_sql, with_views
from stepcorpus.plans.registry import query
from stepcorpus.session import materialize
from stepcorpus.sources.tables import table


R = 3  # patches per regrouped vector
D_IN, D_HID, D_OUT = 3 * 64, 32, 16
# Projection weights are generated by a rule (see features.rule_matrix).
W1_RULE, B1_RULE, W2_RULE, B2_RULE = (0.1, 0.7), (0.01, 1.0), (0.2, 0.3), (0.01, 0.5)


def _weights():
    return (J.rule_matrix(D_HID, D_IN, *W1_RULE), J.rule_vector(D_HID, *B1_RULE),
            J.rule_matrix(D_OUT, D_HID, *W2_RULE), J.rule_vector(D_OUT, *B2_RULE))


def _sum_sql(lst: str) -> str:
    return f"list_reduce(list_transform({lst}, lambda x: cast(x as double)), lambda a, b: a + b, cast(0 as double))"


def _encoded_tokens(spark, d):
    arr = materialize(V.token_arrays(spark, d))
    vocab = K.build_vocab(arr, "toks")
    enc = materialize(K.encode(arr, "toks", vocab, "sample_id", "ids").select("sample_id", "ids"))
    return explode_rows(enc, "ids", ["sample_id"], "pos", "token_id")


_TOKEN_IDS = ("ids", """
select t.sample_id, t.pos, v.token_id from tokens t join vocab v on v.token = t.tok""")
_VOCAB = ("vocab", vocab_sql("select tok as token from tokens"))


@query("j1_lookup_embeddings", with_views(["tokens"], f"""
select i.sample_id, i.pos, i.token_id, cast(e.vec_id is not null as integer) as has_vector,
  round(coalesce({_sum_sql('e.embedding')}, 0.0), 6) as v_sum
from ids i left join embeddings e on e.vec_id = i.token_id""", [_VOCAB, _TOKEN_IDS]))
def j1(spark, d):
    """Chat-sample token ids -> codebook vectors (embeddings table keyed by id)."""
    toks = _encoded_tokens(spark, d)
    out = J.lookup_embeddings(toks, table(spark, d, "embeddings"))
    return out.select("sample_id", F.col("pos").cast("bigint").alias("pos"), "token_id",
                      F.col("vector").isNotNull().cast("int").alias("has_vector"),
                      F.round(F.coalesce(J.vec_sum(F.col("vector")), F.lit(0.0)), 6).alias("v_sum"))


_PADS = ("pads", f"""
select sample_id, cast(row_number() over (partition by sample_id order by pos) - 1 as integer) as k,
  cast(pos as integer) as pos from tokens where tok = {q(S.IMAGE_PAD)}""")


@query("j2_scatter_features", with_views(["tokens", "patches"], f"""
select p.sample_id, p.pos, p.k, coalesce(f.patch_idx, -1) as patch_idx,
  round(coalesce({_sum_sql('f.embedding')}, 0.0), 6) as v_sum
from pads p left join patches f on f.image_id = p.sample_id and f.patch_idx = p.k""", [_PADS]))
def j2(spark, d):
    """k-th image-pad position of a sample takes patch k of its image."""
    pads = J.pad_ordinals(V.token_arrays(spark, d), "sample_id", "toks", F.lit(S.IMAGE_PAD))
    out = J.scatter_features(pads, V.patches(spark, d), "sample_id")
    return out.select("sample_id", "pos", F.col("k").cast("int").alias("k"),
                      F.coalesce("patch_idx", F.lit(-1)).alias("patch_idx"),
                      F.round(F.coalesce(J.vec_sum(F.col("embedding")), F.lit(0.0)), 6).alias("v_sum"))


RAGGED_PADS, RAGGED_PATCHES = (3, 4), (5, 11)  # pads: 3 + conv_id % 4; patches: 5 an image without every 11th vector


def _ragged(spark, d):
    """``(samples, pads, patches)`` with other numbers of pads than of patches in a sample."""
    from stepcorpus.operators import batches as B
    n = (F.lit(RAGGED_PADS[0]) + F.col("conv_id") % RAGGED_PADS[1]).cast("int")
    text = F.concat(F.lit(f"{S.IM_START}user\n"), F.repeat(F.lit(S.IMAGE_PAD), n), F.lit("\n"), F.col("q"))
    rows = V.answered_pairs(spark, d).select(F.col("conv_id").alias("sample_id"), T.tokenize(text).alias("toks"))
    samples = B.batch_assignment(rows.select("sample_id"), "sample_id", S.STAGE1.batch_size, 1, 42)
    e = table(spark, d, "embeddings").filter(F.col("vec_id") % RAGGED_PATCHES[1] != 0)
    patches = e.select(F.floor(F.col("vec_id") / RAGGED_PATCHES[0]).cast("bigint").alias("image_id"), (F.col("vec_id") % RAGGED_PATCHES[0]).cast("int").alias("patch_idx"), "embedding")
    return samples, J.pad_ordinals(rows, "sample_id", "toks", F.lit(S.IMAGE_PAD)), patches


_SIZE = S.STAGE1.batch_size


@query("j2_scatter_batch", with_views(["answered_pairs"], f"""
, placed as (select conv_id, cast((rk - 1) // {_SIZE} as bigint) as batch_id, rk from (select conv_id, row_number() over (order by md5('42:0:' || conv_id), conv_id) as rk from answered_pairs)),
pads as (select p.batch_id, p.conv_id, t.pos, row_number() over (partition by p.batch_id order by p.rk, t.pos) - 1 as n
  from placed p join (select conv_id, unnest(range(len(toks))) as pos, unnest(toks) as tok from (
    select conv_id, regexp_extract_all({sql_text(f"{S.IM_START}user{chr(10)}")} || repeat({q(S.IMAGE_PAD)}, ({RAGGED_PADS[0]} + conv_id % {RAGGED_PADS[1]})::bigint) || chr(10) || q, {TOKEN_RE}, 0) as toks
    from answered_pairs)) t using (conv_id) where t.tok = {q(S.IMAGE_PAD)}),
feats as (select p.batch_id, e.vec_id, row_number() over (partition by p.batch_id order by p.rk, e.vec_id) - 1 as n
  from placed p join embeddings e on e.vec_id // {RAGGED_PATCHES[0]} = p.conv_id where e.vec_id % {RAGGED_PATCHES[1]} <> 0)
select pads.batch_id, pads.conv_id as sample_id, pads.pos::integer as pos, n, coalesce(vec_id // {RAGGED_PATCHES[0]}, -1) as image_id, coalesce(vec_id % {RAGGED_PATCHES[0]}, -1)::integer as patch_idx
from pads left join feats using (batch_id, n)"""))
def j2_batch(spark, d):
    """Pads and patches numbered over whole batches of 16: a sample's surplus goes to the next sample's pads."""
    samples, pads, patches = _ragged(spark, d)
    out = J.scatter_features_in_batch(pads, patches, samples, "sample_id", "batch_id", "slot")
    return out.select("batch_id", "sample_id", "pos", F.col("n").cast("bigint").alias("n"), F.coalesce("image_id", F.lit(-1).cast("bigint")).alias("image_id"), F.coalesce("patch_idx", F.lit(-1)).alias("patch_idx"))


_POOLED = ("pooled", """
select f.image_id,
  list_concat(list_concat(list_transform(f.embedding, lambda x: cast(x as double)), a.avg_d), a.max_d) as pooled
from (select image_id, embedding from patches
      qualify row_number() over (partition by image_id order by patch_idx) = 1) f
join (select image_id, list(m order by d) as avg_d, list(x order by d) as max_d from (
        select image_id, d, avg(x) as m, max(x) as x from (
          select image_id, unnest(range(len(embedding))) as d, cast(unnest(embedding) as double) as x from patches)
        group by image_id, d) group by image_id) a using (image_id)""")


@query("j3_insert_first_pad", with_views(["tokens", "patches"], f"""
select s.sample_id, cast(coalesce(f.first_pad, -1) as bigint) as first_pad,
  cast(pl.image_id is not null as integer) as has_feature, round(coalesce(list_sum(pl.pooled), 0.0), 6) as pooled_sum
from (select distinct sample_id from tokens) s
left join (select sample_id, min(pos) as first_pad from pads group by sample_id) f using (sample_id)
left join pooled pl on pl.image_id = s.sample_id""", [_PADS, _POOLED]))
def j3(spark, d):
    """Only the first pad position of a sample takes the pooled image vector."""
    firsts = V.token_arrays(spark, d).select("sample_id", J.first_pad(F.col("toks"), F.lit(S.IMAGE_PAD)).alias("first_pad"))
    out = J.insert_first_pad(firsts, J.pool_patches(V.patches(spark, d)), "sample_id")
    return out.select("sample_id", F.col("first_pad").cast("bigint").alias("first_pad"),
                      F.col("pooled").isNotNull().cast("int").alias("has_feature"),
                      F.round(F.coalesce(J.vec_sum(F.col("pooled")), F.lit(0.0)), 6).alias("pooled_sum"))


_GROUPS = ("groups", f"""
select image_id, cast(patch_idx // {R} as integer) as group_idx, any_value(n) as n,
  flatten(list(embedding order by patch_idx)) as v
from (select *, count(*) over (partition by image_id) as n from patches) group by image_id, patch_idx // {R}""")


@query("j4_regroup_patches", with_views(["patches"], f"""
select image_id, group_idx, case when n % {R} = 0 then 'ok' else 'not_divisible' end as status,
  case when n % {R} = 0 then cast(len(v) as bigint) else 0 end as n_values,
  round(case when n % {R} = 0 then {_sum_sql('v')} else 0.0 end, 6) as v_sum
from groups""", [_GROUPS]))
def j4(spark, d):
    """Every 3 consecutive patch vectors of an image concatenated; short images flagged."""
    g = J.regroup_patches(V.patches(spark, d), R)
    return g.select("image_id", "group_idx", "status",
                    F.coalesce(F.size("vector").cast("bigint"), F.lit(0).cast("bigint")).alias("n_values"),
                    F.round(F.coalesce(J.vec_sum(F.col("vector")), F.lit(0.0)), 6).alias("v_sum"))


@query("j5_pool_patches", with_views(["patches"], """
select image_id, j, round(v, 6) as v from (
  select image_id, cast(unnest(range(len(pooled))) as integer) as j, unnest(pooled) as v from pooled)""", [_POOLED]))
def j5(spark, d):
    """[first patch, mean, max] per image, one row per output dimension."""
    p = J.pool_patches(V.patches(spark, d))
    return explode_rows(p, "pooled", ["image_id"], "j", "v").withColumn("v", F.round("v", 6))


def _w_sql(name: str, rows: int, cols: int, rule: tuple[float, float], a: str, b: str) -> tuple[str, str]:
    scale, freq = rule
    return (name, f"""
select t.{a}, u.{b}, {scale} * sin({freq} * (t.{a} * {cols} + u.{b})) as w
from (select unnest(range({rows})) as {a}) t, (select unnest(range({cols})) as {b}) u""")


def _b_sql(name: str, n: int, rule: tuple[float, float], a: str) -> tuple[str, str]:
    scale, freq = rule
    return (name, f"select {a}, {scale} * cos({freq} * {a}) as b from (select unnest(range({n})) as {a})")


@query("j6_project", with_views(["patches"], """
select image_id, group_idx, y.o, round(y.y, 6) as y from (
  select a.image_id, a.group_idx, w2.o, sum(a.a * w2.w) + any_value(b2.b) as y
  from (select h.image_id, h.group_idx, h.h, h.z / (1 + exp(-h.z)) as a from (
          select x.image_id, x.group_idx, w1.h, sum(x.x * w1.w) + any_value(b1.b) as z
          from (select image_id, group_idx, unnest(range(len(v))) as i, cast(unnest(v) as double) as x
                from groups where n % 3 = 0) x
          join w1 on w1.i = x.i join b1 on b1.h = w1.h group by x.image_id, x.group_idx, w1.h) h) a
  join w2 on w2.h = a.h join b2 on b2.o = w2.o group by a.image_id, a.group_idx, w2.o) y""",
                               [_GROUPS, _w_sql("w1", D_HID, D_IN, W1_RULE, "h", "i"), _b_sql("b1", D_HID, B1_RULE, "h"),
                                _w_sql("w2", D_OUT, D_HID, W2_RULE, "o", "h"), _b_sql("b2", D_OUT, B2_RULE, "o")]))
def j6(spark, d):
    """Regrouped patch vectors through Linear -> SiLU -> Linear (NumPy per Arrow batch)."""
    g = J.regroup_patches(V.patches(spark, d), R).filter(F.col("status") == "ok")
    w1, b1, w2, b2 = _weights()
    p = J.project(g.select("image_id", "group_idx", "vector"), "vector", w1, b1, w2, b2, "silu")
    return (explode_rows(p, "projected", ["image_id", "group_idx"], "o", "y")
            .select("image_id", "group_idx", F.col("o").cast("bigint").alias("o"), F.round("y", 6).alias("y")))


@query("j7_gather_steps", with_views(["stage3_ids", "stage3_tokens"], f"""
select s.conv_id, s.step_no, s.place, s.pos, i.token_id, cast(e.vec_id is not null as integer) as has_vector,
  round(coalesce({_sum_sql('e.embedding')}, 0.0), 6) as v_sum
from (select conv_id, place, cast(unnest(range(len(hs))) as integer) as step_no,
        unnest(list_transform(hs, lambda h: cast(len(regexp_extract_all(before
          || substr(instruction, 1, instr(instruction, h) - 1), {TOKEN_RE}, 0)) as bigint))) as pos
      from (select conv_id, instruction, place, before, regexp_extract_all(instruction, {STEP_RE}, 1) as hs from stage3_tokens,
              (values ('raw', ''), ('templated', {sql_text(stage3_prompt_prefix())})) p(place, before))) s
join stage3_ids i on i.conv_id = s.conv_id and i.pos = s.pos
left join embeddings e on e.vec_id = i.token_id"""))
def j7(spark, d):
    """Hidden vector (here: the codebook vector) at each step's positions: the
    training script's (relative to the raw instruction) and the one in the prompt."""
    valid = G.stage3_valid(V.step_records_full(spark, d), V.manifest(spark, d), V.IMAGE_BASE)
    toks = materialize(G.stage3_tokens(valid))
    vocab = K.build_vocab(toks, "tokens")
    enc = G.encode_stage(toks, vocab)
    # ids of the step positions in the row, so only those meet the codebook
    at = F.transform("steps", lambda s: F.array(*[
        F.struct(s["step_no"].alias("step_no"), F.lit(place).alias("place"), s[idx].alias("pos"), F.get(F.col("ids"), s[idx]).alias("token_id"))
        for place, idx in (("raw", "token_idx"), ("templated", "token_idx_templated"))]))
    steps = materialize(explode_rows(enc.select("conv_id", F.flatten(at).alias("at")), "at", ["conv_id"], value="s").select("conv_id", "s.*"))
    out = J.lookup_embeddings(steps.filter(F.col("token_id").isNotNull()), table(spark, d, "embeddings"))
    return out.select("conv_id", "step_no", "place", F.col("pos").cast("bigint").alias("pos"), "token_id",
                      F.col("vector").isNotNull().cast("int").alias("has_vector"),
                      F.round(F.coalesce(J.vec_sum(F.col("vector")), F.lit(0.0)), 6).alias("v_sum"))
