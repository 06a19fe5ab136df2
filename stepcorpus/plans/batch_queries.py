"""Queries for B1-B5 and T12: split, batches, padding, masks, schedule."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.functions.arrays import explode_rows
from stepcorpus.operators import batches as B
from stepcorpus.operators import tokens as K
from stepcorpus.plans import stages as G
from stepcorpus.plans import views as V
from stepcorpus.plans.oracle_views import TOKEN_RE, q, with_views
from stepcorpus.plans.registry import query
from stepcorpus.plans.token_queries import _SEGMENTS
from stepcorpus.session import materialize
from stepcorpus.sources.tables import table


BATCH = S.STAGE3.batch_size
EPOCHS = S.STAGE3.epochs


@query("b1_exact_split", """
select doc_id, case when row_number() over (order by md5('42:' || doc_id), doc_id)
    <= floor(count(*) over () * cast(0.05 as double)) then 'validation' else 'train' end as split
from documents""")
def b1(spark, d):
    """Exactly int(5% of n) documents to validation, seeded, repeatable."""
    docs = table(spark, d, "documents").select("doc_id")
    return B.exact_split(docs, "doc_id", S.STAGE3.val_fraction, S.STAGE3.seed)


@query("b2_assign_batches", f"""
select doc_id, epoch, cast((rk - 1) // {BATCH} as bigint) as batch_id, cast((rk - 1) % {BATCH} as integer) as slot
from (select doc_id, epoch, row_number() over (partition by epoch order by md5('42:' || epoch || ':' || doc_id), doc_id) as rk
      from (select doc_id, unnest(range({EPOCHS})) as epoch from documents))""")
def b2(spark, d):
    """Per-epoch seeded order of the documents cut into batches of 4, two epochs."""
    docs = table(spark, d, "documents").select("doc_id")
    return B.assign_batches(docs, "doc_id", BATCH, EPOCHS, S.STAGE3.seed).select("doc_id", "epoch", "batch_id", "slot")


def _scrambled_sql(half: str) -> str:
    x = f"((({half}) + k[2]) % {2 ** 31} * k[3]) % {2 ** 31}"
    y = f"(xor({x}, ({x}) >> 15) * k[3] % {2 ** 31})"
    return f"xor({y}, {y} >> 13)"


def _permuted_sql(x: str, epoch: int) -> str:
    """One application of the bijection to ``x`` in a table with the sides a and b."""
    keys = ", ".join(f"[{r}, {add}, {factor}]" for r, (add, factor) in enumerate(B.round_keys(S.STAGE3.seed, epoch)))
    return (f"list_transform([list_reduce([[({x}) // b, ({x}) % b, 0], {keys}], lambda s, k: case when k[1] % 2 = 1 then [s[1], (s[2] + {_scrambled_sql('s[1]')}) % b, 0] "
            f"else [(s[1] + {_scrambled_sql('s[2]')}) % a, s[2], 0] end)], lambda p: p[1] * b + p[2])[1]")


@query("b2_permuted_batches", f"""
with recursive r as (select doc_id, row_number() over (order by doc_id) - 1 as rank, count(*) over () as n from documents),
s as (select *, ceil(sqrt(n))::bigint as a, ceil(n / ceil(sqrt(n)))::bigint as b from r),
w as (select doc_id, epoch, n, a, b, case epoch {' '.join(f"when {e} then {_permuted_sql('rank', e)}" for e in range(EPOCHS))} end as place from s, (select unnest(range({EPOCHS})) as epoch)
  union all select doc_id, epoch, n, a, b, case epoch {' '.join(f"when {e} then {_permuted_sql('place', e)}" for e in range(EPOCHS))} end from w where place >= n)
select doc_id, epoch, (place // {BATCH})::bigint as batch_id, (place % {BATCH})::integer as slot from w where place < n""")
def b2_permuted(spark, d):
    """Batches of 4 in an order computed in the row: one rank of the documents, a keyed bijection an epoch."""
    return B.permuted_batches(table(spark, d, "documents").select("doc_id"), "doc_id", BATCH, EPOCHS, S.STAGE3.seed)


@query("b3_pad_batch", with_views(["tokens"], f"""
, {_SEGMENTS.strip()},
full_ as (select s.sample_id, s.pos, s.tok,
    case when g.a is not null and g.e is not null and s.pos > g.a then s.tok else {q(S.PAD_TOKEN)} end as lab
  from seg s join grp g using (sample_id, seg)),
shifted as (select sample_id, pos, tok, lead(lab) over (partition by sample_id order by pos) as lab,
    count(*) over (partition by sample_id) - 1 as n from full_),
b as (select sample_id, n, cast((rk - 1) // 4 as bigint) as batch_id, cast((rk - 1) % 4 as integer) as slot,
        max(n) over (partition by (rk - 1) // 4) as max_len
      from (select sample_id, n, row_number() over (order by md5('42:0:' || sample_id), sample_id) as rk
            from (select distinct sample_id, n from shifted)))
select cast(0 as bigint) as epoch, p.batch_id, p.slot, p.sample_id, p.pos,
  coalesce(s.tok, {q(S.PAD_TOKEN)}) as input_tok, coalesce(s.lab, {q(S.PAD_TOKEN)}) as label_tok
from (select batch_id, slot, sample_id, unnest(range(max_len)) as pos from b) p
left join shifted s on s.sample_id = p.sample_id and s.pos = p.pos and s.pos < s.n"""))
def b3(spark, d):
    """Stage-2-style samples (span labels, shifted) in batches of 4, padded to the batch maximum."""
    arr = V.token_arrays(spark, d)
    spans, _ = K.assistant_spans(F.col("toks"), F.lit(S.ROLE_ASSISTANT), F.lit(S.IM_END))
    lab = K.span_mask_labels(F.col("toks"), spans, F.lit(S.PAD_TOKEN))
    ids, labels = K.shift_pair(F.col("toks"), lab)
    s = arr.select("sample_id", ids.alias("input"), labels.alias("labels"))
    s = B.assign_batches(s, "sample_id", 4, 1, 42)
    s = B.pad_to_batch_max(s, {"input": F.lit(S.PAD_TOKEN), "labels": F.lit(S.PAD_TOKEN)}, "input")
    z = F.arrays_zip(F.col("input").alias("i"), F.col("labels").alias("l"))
    return (explode_rows(s, z, ["epoch", "batch_id", "slot", "sample_id"], "pos", "z")
            .select("epoch", "batch_id", "slot", "sample_id", F.col("pos").cast("bigint").alias("pos"),
                    F.col("z.i").alias("input_tok"), F.col("z.l").alias("label_tok")))


def _stage3_split(rows, split="train"):
    return B.exact_split(rows, "conv_id", S.STAGE3.val_fraction, S.STAGE3.seed).filter(F.col("split") == split)


def stage3_tokens_written(spark, d):
    valid = G.stage3_valid(V.step_records_full(spark, d), V.manifest(spark, d), V.IMAGE_BASE)
    return materialize(G.stage3_tokens(valid))


def stage3_step_batches(spark, d):
    """The train batches' step lists without the ids: the split and batch
    assignment depend only on the set of keys and the seed, so they are the
    ones ``stage3_batches`` gives, without building a vocabulary or encoding."""
    batches = B.assign_batches(_stage3_split(stage3_tokens_written(spark, d).select("conv_id", "steps")),
                               "conv_id", BATCH, EPOCHS, S.STAGE3.seed)
    return batches.withColumn("steps", F.coalesce(F.col("steps"), F.array().cast(batches.schema["steps"].dataType)))


def stage3_batches(spark, d, split="train", epochs=EPOCHS):
    """Stage 3: valid records -> prompt tokens -> ids -> one split's batches, padded."""
    toks = stage3_tokens_written(spark, d)
    vocab = K.build_vocab(toks, "tokens")
    # Written: the ids and step lists only (no token strings; labels are a copy of the ids).
    enc = materialize(G.encode_stage(toks, vocab).select("conv_id", "ids", "steps"))
    enc = enc.withColumn("labels", K.clone_labels(F.col("ids")))
    batches = B.assign_batches(_stage3_split(enc, split), "conv_id", BATCH, epochs, S.STAGE3.seed, length_of="ids")
    return B.pad_batch_steps(batches, "ids", "labels", F.lit(0).cast("bigint"),
                             F.lit(S.LABEL_IGNORE).cast("bigint"), "steps", max_len="max_len")


_B4_LONG = f"""
select p.epoch, p.batch_id, p.slot, p.conv_id, p.pos, coalesce(i.token_id, 0) as input_id,
  coalesce(i.token_id, {S.LABEL_IGNORE}) as label, cast(coalesce(i.token_id, 0) <> 0 as integer) as attention_mask
from (select epoch, batch_id, slot, conv_id, unnest(range(max_len)) as pos from stage3_batches) p
left join stage3_ids i on i.conv_id = p.conv_id and i.pos = p.pos"""


@query("b4_pad_batch_steps", with_views(["stage3_batches", "stage3_ids"], _B4_LONG))
def b4(spark, d):
    """Stage-3 train batches: ids padded with the pad id, labels with -100, mask."""
    s = stage3_batches(spark, d)
    z = F.arrays_zip(F.col("ids").alias("i"), F.col("labels").alias("l"), F.col("attention_mask").alias("m"))
    return (explode_rows(s, z, ["epoch", "batch_id", "slot", "conv_id"], "pos", "z")
            .select("epoch", "batch_id", "slot", "conv_id", F.col("pos").cast("bigint").alias("pos"),
                    F.col("z.i").alias("input_id"), F.col("z.l").alias("label"), F.col("z.m").alias("attention_mask")))


@query("b4_validation_batches", with_views(["stage3_validation", "stage3_ids"], f"""
select p.batch_id, p.slot, p.conv_id, p.pos, coalesce(i.token_id, 0) as input_id, coalesce(i.token_id, {S.LABEL_IGNORE}) as label,
  cast(coalesce(i.token_id, 0) <> 0 as integer) as attention_mask
from (select batch_id, slot, conv_id, unnest(range(max_len)) as pos from stage3_validation) p
left join stage3_ids i on i.conv_id = p.conv_id and i.pos = p.pos"""))
def b4_validation(spark, d):
    """Stage-3 validation batches, padded like the train batches, one pass."""
    s = stage3_batches(spark, d, "validation", 1)
    z = F.arrays_zip(F.col("ids").alias("i"), F.col("labels").alias("l"), F.col("attention_mask").alias("m"))
    return (explode_rows(s, z, ["batch_id", "slot", "conv_id"], "pos", "z")
            .select("batch_id", "slot", "conv_id", F.col("pos").cast("bigint").alias("pos"),
                    F.col("z.i").alias("input_id"), F.col("z.l").alias("label"), F.col("z.m").alias("attention_mask")))


@query("b4_batch_step_lists", with_views(["stage3_batches"], f"""
select b.epoch, b.batch_id, b.slot, b.conv_id, cast(s.step_no as integer) as step_no,
  cast(len(regexp_extract_all(substr(s.instruction, 1, instr(s.instruction, s.header) - 1), {TOKEN_RE}, 0)) as integer)
    as token_idx, s.label
from stage3_batches b join (
  select conv_id, instruction, unnest(range(len(hs))) as step_no, unnest(hs) as header,
    unnest(list_transform(cs, lambda c: case when contains(c, '<pos>') then 1 when contains(c, '<neg>') then 0 else 1 end))
      as label
  from (select conv_id, instruction, regexp_extract_all(instruction, {q(S.STEP_PATTERN_RE2)}, 1) as hs,
          regexp_extract_all(instruction, {q(S.STEP_PATTERN_RE2)}, 0) as cs from stage3_tokens)) s using (conv_id)"""))
def b4_steps(spark, d):
    """The ragged step lists (step index, label) that travel with each batch row."""
    s = stage3_step_batches(spark, d)
    return (explode_rows(s, "steps", ["epoch", "batch_id", "slot", "conv_id"], value="s")
            .select("epoch", "batch_id", "slot", "conv_id", "s.step_no", "s.token_idx", "s.label"))


@query("t12_attention_mask", with_views(["stage3_batches", "stage3_ids"], f"""
select epoch, batch_id, slot, conv_id, count(*) as n_positions, cast(sum(attention_mask) as bigint) as n_attended
from ({_B4_LONG}) group by epoch, batch_id, slot, conv_id"""))
def t12(spark, d):
    """Attention mask after padding: positions and attended positions per batch row."""
    s = stage3_batches(spark, d)
    return s.select("epoch", "batch_id", "slot", "conv_id", F.size("attention_mask").cast("bigint").alias("n_positions"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attended"))


SCHED = dict(accum=S.STAGE3.grad_accum, log_steps=5, save_steps=10, eval_steps=10)


@query("b5_schedule", f"""
with b as (select doc_id, epoch, (rk - 1) // {BATCH} as batch_id, len(regexp_extract_all(text, {TOKEN_RE}, 0)) as n_tok
           from (select doc_id, text, epoch,
                   row_number() over (partition by epoch order by md5('42:' || epoch || ':' || doc_id), doc_id) as rk
                 from (select doc_id, text, unnest(range({EPOCHS})) as epoch from documents))),
e as (select epoch, ceil((max(batch_id) + 1) / {SCHED['accum']}) as spe from b group by epoch),
s as (select cast(b.epoch * e.spe + b.batch_id // {SCHED['accum']} + 1 as bigint) as global_step, b.* from b join e using (epoch))
select global_step, count(distinct (epoch, batch_id)) as n_micro_batches, count(*) as n_rows,
  cast(sum(n_tok) as bigint) as n_tokens, cast(global_step % {SCHED['log_steps']} = 0 as integer) as is_log,
  cast(global_step % {SCHED['save_steps']} = 0 as integer) as is_save,
  cast(global_step % {SCHED['eval_steps']} = 0 as integer) as is_eval
from s group by global_step""")
def b5(spark, d):
    """Documents in batches of 4 over two epochs -> optimizer steps (accumulation 8) with flags."""
    docs = table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tok"))
    b = B.assign_batches(docs, "doc_id", BATCH, EPOCHS, S.STAGE3.seed)
    out = B.schedule(b, SCHED["accum"], SCHED["log_steps"], SCHED["save_steps"], SCHED["eval_steps"], F.col("n_tok"))
    return out.withColumn("n_tokens", F.col("n_tokens").cast("bigint"))
