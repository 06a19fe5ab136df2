"""Queries for M1-M11: head scoring, training, losses, selection, checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.functions.arrays import explode_rows
from stepcorpus.operators import batches as B
from stepcorpus.operators import features as J
from stepcorpus.operators import scoring as M
from stepcorpus.operators import tokens as K
from stepcorpus.plans import stages as G
from stepcorpus.plans import views as V
from stepcorpus.plans.batch_queries import stage3_tokens_written
from stepcorpus.plans.oracle_views import TOKEN_RE, q, with_views
from stepcorpus.plans.registry import query
from stepcorpus.session import materialize
from stepcorpus.sources.tables import table


DIM = 64
HEAD_RULES = dict(w_dense=(0.15, 0.37), b_dense=(0.01, 0.9), w_cls=(0.3, 0.11), b_cls=(0.05, 2.0))
PROBE_W, PROBE_B = (0.5, 0.23), (0.1, 1.3)  # linear probe for M4/M5 step logits
SCORED_BATCH = 12  # score groups in a batch (M3)
IGNORE = 0  # the pad id: positions labelled with it are not scored (M3)
TOP_K, TEMPERATURE, SEED = 5, 0.7, 42


def _head():
    r = HEAD_RULES
    return (J.rule_matrix(DIM, DIM, *r["w_dense"]), J.rule_vector(DIM, *r["b_dense"]),
            J.rule_matrix(2, DIM, *r["w_cls"]), J.rule_vector(2, *r["b_cls"]))


def _rule_sql(fn: str, rule: tuple[float, float], place: str) -> str:
    return f"{rule[0]} * {fn}({rule[1]} * ({place}))"


def _head_sql(source: str) -> list[tuple[str, str]]:
    """The head's logits (``head``: vec_id, l0, l1) of ``source`` (vec_id, embedding); erf by its series
    2 / sqrt(pi) * exp(-t^2) * sum of 2^n t^(2n+1) / (2n+1)!!, whose terms have one sign."""
    coefficients = [1.0]
    for n in range(1, 60):
        coefficients.append(coefficients[-1] * 2 / (2 * n + 1))
    erf = f"2 / sqrt(pi()) * exp(-t * t) * list_sum(list_transform({coefficients}, lambda c, n: c * pow(t, 2 * n - 1)))"
    return [("dense", f"""
select vec_id, h, sum(x * ({_rule_sql('sin', HEAD_RULES['w_dense'], f'h * {DIM} + i')})) + {_rule_sql('cos', HEAD_RULES['b_dense'], 'h')} as z
from (select vec_id, unnest(range({DIM})) as i, unnest(embedding)::double as x from {source}), (select unnest(range({DIM})) as h) group by vec_id, h"""),
            ("gelu", f"select vec_id, h, 0.5 * z * (1 + {erf}) as g from (select *, z / sqrt(2) as t from dense)"),
            ("normed", "select vec_id, h, (g - avg(g) over w) / sqrt(var_pop(g) over w + 1e-5) as y from gelu window w as (partition by vec_id)"),
            ("head", "select vec_id, " + ", ".join(f"sum(y * ({_rule_sql('sin', HEAD_RULES['w_cls'], f'{k} * {DIM} + h')})) + {_rule_sql('cos', HEAD_RULES['b_cls'], str(k))} as l{k}" for k in (0, 1))
             + " from normed group by vec_id")]


@query("m1_score_steps", with_views(["step_features"], """
select vec_id, label, round(l0, 6) as logit_0, round(l1, 6) as logit_1, round(1 / (1 + exp(l0 - l1)), 6) as p_correct
from head join step_features using (vec_id)""", _head_sql("step_features")))
def m1(spark, d):
    """Step features through dense -> GELU -> LayerNorm -> 2 logits (NumPy per Arrow batch)."""
    f = V.step_features(spark, d)
    out = M.score_steps(f, "embedding", *_head())
    return out.select("vec_id", "label", *(F.round(c, 6).alias(c) for c in ("logit_0", "logit_1", "p_correct")))


@query("m2_fit_step_verifier")
def m2(spark, d):
    """Logistic regression fitted on the step features; in-sample predictions."""
    model, data = M.fit_step_verifier(V.step_features(spark, d), "embedding", "label")
    pred = model.transform(data)
    from pyspark.ml.functions import vector_to_array
    return pred.select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"),
                       F.get(vector_to_array(F.col("probability")), 1).alias("p_correct"))


RIDGE = 0.01  # of the certified fit: with it the optimum exists on separable data too


@query("m2_optimality", with_views(["step_features"], f"""
select feature::integer as feature, 0.0::double as gradient, 1 as is_curved, n, n_pos
from (select count(*) as n, sum(label)::bigint as n_pos from step_features), (select unnest(range({DIM + 1})) as feature)"""))
def m2_optimality(spark, d):
    """The certificate of a regularized fit: every parameter's gradient, 0 to four places, and positive curvature."""
    f = materialize(V.step_features(spark, d).select("embedding", "label"), "step-features")
    model, _ = M.fit_step_verifier(f, "embedding", "label", max_iter=500, reg=RIDGE, standardization=False, tol=1e-12)
    c = M.optimality(f, "embedding", "label", model.coefficients.toArray(), float(model.intercept), RIDGE)
    return c.select("feature", (F.round("gradient", 4) + F.lit(0.0)).alias("gradient"), (F.col("curvature") > 0).cast("int").alias("is_curved"), "n", "n_pos")


def _gen(spark, d):
    labels = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("grp"), F.col("label").cast("bigint").alias("label"),
        F.floor(F.col("vec_id") / SCORED_BATCH).cast("bigint").alias("batch_id"))
    return M.token_nll(V.scores(spark, d), labels, "grp", "batch_id", IGNORE)


_GEN_SQL = ("gen", f"""
select batch_id, count(nll) as n_tokens, avg(nll) as gen_loss, count(*) filter (batch_id is null or label <> {IGNORE} and own is null) as n_unmatched from (
  select s.grp, e.batch_id, e.label, max(case when s.item = e.label then s.score end) as own,
    case when e.label <> {IGNORE} then max(s.mx) + ln(sum(exp(s.score - s.mx)))
         - max(case when s.item = e.label then s.score end) end as nll
  from (select *, max(score) over (partition by grp) as mx from scores) s
  full join (select vec_id, cast(label as bigint) as label, cast(floor(vec_id / {SCORED_BATCH}) as bigint) as batch_id
        from embeddings) e on e.vec_id = s.grp
  group by s.grp, e.batch_id, e.label) group by batch_id""")


@query("m3_token_nll", with_views(["scores"], """
select batch_id, n_tokens, n_unmatched, cast(gen_loss is not null as integer) as has_loss, round(coalesce(gen_loss, 0.0), 6) as gen_loss
from gen""", [_GEN_SQL]))
def m3(spark, d):
    """Mean token cross-entropy per batch, pad-labelled positions ignored."""
    g = _gen(spark, d)
    return g.select("batch_id", "n_tokens", "n_unmatched", F.col("gen_loss").isNotNull().cast("int").alias("has_loss"),
                    F.round(F.coalesce("gen_loss", F.lit(0.0)), 6).alias("gen_loss"))


def _probe_sql(k: int) -> str:
    scale, freq = PROBE_W
    bscale, bfreq = PROBE_B
    w = ", ".join(repr(float(x)) for x in J.rule_matrix(2, DIM, scale, freq)[k])
    b = float(J.rule_vector(2, bscale, bfreq)[k])
    return f"(list_reduce(list_transform(list_zip(embedding, [{w}]), lambda p: cast(p[1] as double) * p[2]), " \
           f"lambda a, c: a + c, cast(0 as double)) + {b!r})"


_VER_SQL = ("ver", f"""
select batch_id, count(*) as n_steps, avg(greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1)))
  - case when label = 1 then l1 else l0 end) as ver_loss
from (select vec_id, label, {_probe_sql(0)} as l0, {_probe_sql(1)} as l1,
        cast((row_number() over (order by md5('{SEED}:0:' || vec_id), vec_id) - 1) // {S.STAGE3.batch_size} as bigint)
          as batch_id
      from step_features) group by batch_id""")


def _ver(spark, d):
    f = V.step_features(spark, d)
    w = J.rule_matrix(2, DIM, *PROBE_W)
    b = J.rule_vector(2, *PROBE_B)
    l0, l1 = M.linear_logits(F.col("embedding"), w.tolist(), b.tolist())
    steps = B.assign_batches(f.select("vec_id", "label", l0.alias("l0"), l1.alias("l1")), "vec_id",
                             S.STAGE3.batch_size, 1, SEED)
    return M.verification_nll(steps, "batch_id", "l0", "l1", "label")


@query("m4_verification_nll", with_views(["step_features"], "select batch_id, n_steps, round(ver_loss, 6) as ver_loss from ver", [_VER_SQL]))
def m4(spark, d):
    """Two-class step cross-entropy averaged over all steps of each batch of 4."""
    return _ver(spark, d).select("batch_id", "n_steps", F.round("ver_loss", 6).alias("ver_loss"))


@query("m4_ragged_batches", with_views(["stage3_batches", "stage3_ids", "stage3_steps"], f"""
select b.epoch, b.batch_id, count(*) as n_samples, count(s.n) as n_with_steps, coalesce(sum(s.n), 0)::bigint as n_steps,
  (sum(s.n) is not null)::integer as has_loss, round(coalesce(sum(s.s) / sum(s.n), 0.0), 6) as ver_loss, round(coalesce(avg(s.s / s.n), 0.0), 6) as sample_mean
from stage3_batches b left join (
  select t.conv_id, count(*) as n, sum(greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) - case when t.label = 1 then l1 else l0 end) as s
  from stage3_steps t join stage3_ids i on i.conv_id = t.conv_id and i.pos = t.token_idx
  join head h on h.vec_id = case when i.token_id in (select vec_id from embeddings) then i.token_id else -1 end group by t.conv_id) s using (conv_id)
group by b.epoch, b.batch_id""", [("codes", f"select vec_id, embedding from embeddings union all select -1, list_transform(range({DIM}), lambda x: 0.0)"), *_head_sql("codes")]))
def m4_ragged(spark, d):
    """Stage-3 train batches: the ids at every sample's step positions gathered in the row, their vectors through the
    verification head (a token without one has zeros), one loss a batch over all of its 0 to many steps."""
    toks = stage3_tokens_written(spark, d)
    enc = G.encode_stage(toks, K.build_vocab(toks, "tokens"))
    at = F.transform("steps", lambda s: F.struct(F.get(F.col("ids"), s["token_idx"]).alias("token_id"), s["label"].alias("label")))
    split = B.exact_split(enc.select("conv_id", at.alias("at")), "conv_id", S.STAGE3.val_fraction, S.STAGE3.seed).filter(F.col("split") == "train")
    rows = materialize(B.assign_batches(split, "conv_id", S.STAGE3.batch_size, S.STAGE3.epochs, S.STAGE3.seed).select("epoch", "batch_id", "conv_id", "at"), "ragged")
    steps = explode_rows(rows, "at", ["epoch", "batch_id", "conv_id"], value="s").select("epoch", "batch_id", "conv_id", "s.token_id", "s.label")
    steps = steps.filter(F.col("token_id").isNotNull())  # a position beyond the sample has no state
    found = J.lookup_embeddings(steps, table(spark, d, "embeddings"))
    states = found.withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0).cast("float"), DIM)))
    scored = M.score_steps(states.select("epoch", "batch_id", "conv_id", "label", "vector"), "vector", *_head())
    out = M.ragged_verification_nll(rows, scored, ["epoch", "batch_id"], "conv_id", "logit_0", "logit_1", "label")
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c)
    return out.select("epoch", "batch_id", "n_samples", "n_with_steps", "n_steps", F.col("ver_loss").isNotNull().cast("int").alias("has_loss"), zero("ver_loss"), zero("sample_mean"))


_ASSIGN_SQL = ("assigned", f"""
select vec_id, cast((row_number() over (order by md5('{SEED}:0:' || vec_id), vec_id) - 1) // {S.STAGE3.batch_size} as bigint) as batch_id
from step_features""")
_SHARED_GEN_SQL = ("shared_gen", f"""
select a.batch_id, avg(case when e.label <> {IGNORE} then t.lse - t.own end) as gen_loss from assigned a join embeddings e using (vec_id) join (
  select s.grp, max(mx) + ln(sum(exp(s.score - mx))) as lse, max(case when s.item = l.label then s.score end) as own
  from (select *, max(score) over (partition by grp) as mx from scores) s join embeddings l on l.vec_id = s.grp group by s.grp) t on t.grp = a.vec_id
group by a.batch_id""")


@query("m5_combined_loss", with_views(["scores", "step_features"], """
select batch_id, cast(g.gen_loss is not null as integer) as has_gen, 1 as has_ver,
  round(v.ver_loss + coalesce(g.gen_loss, 0.0), 6) as total_loss
from ver v left join shared_gen g using (batch_id)""", [_ASSIGN_SQL, _SHARED_GEN_SQL, _VER_SQL]))
def m5(spark, d):
    """Generation + verification loss of the same batches: both terms from one assignment of the labelled vectors."""
    f = V.step_features(spark, d)
    batch = B.batch_assignment(f.select("vec_id"), "vec_id", S.STAGE3.batch_size, 1, SEED).select(F.col("vec_id").alias("grp"), "batch_id")
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("grp"), F.col("label").cast("bigint").alias("label"))
    gen = M.token_nll(V.scores(spark, d), own.join(batch, "grp"), "grp", "batch_id", IGNORE)
    c = M.combined_loss(gen, _ver(spark, d), "batch_id")
    return c.select("batch_id", F.col("gen_loss").isNotNull().cast("int").alias("has_gen"),
                    F.col("ver_loss").isNotNull().cast("int").alias("has_ver"),
                    F.round("total_loss", 6).alias("total_loss"))


_TOPK_SQL = ("topk", f"""
select grp, item, e / sum(e) over (partition by grp) as prob from (
  select grp, item, exp(s - max(s) over (partition by grp)) as e from (
    select grp, item, s, coalesce(nth_value(s, {TOP_K}) over (partition by grp order by s desc
          rows between unbounded preceding and unbounded following), min(s) over (partition by grp)) as kth
    from (select grp, item, score / {TEMPERATURE} as s from scores))
  where s >= kth)""")


@query("m6_top_k_softmax", with_views(["scores"], "select grp, item, round(prob, 6) as prob from topk", [_TOPK_SQL]))
def m6(spark, d):
    """Top-5 (ties kept) softmax at temperature 0.7 per score group."""
    return (M.top_k_softmax(V.scores(spark, d), "grp", TOP_K, TEMPERATURE)
            .select("grp", "item", F.round("prob", 6).alias("prob")))


@query("m6_softmax_full", with_views(["scores"], """
select grp, item, round(e / sum(e) over (partition by grp), 6) as prob, 'all' as kept from (
  select grp, item, exp(score - max(score) over (partition by grp)) as e from scores)
union all
select grp, item, 1.0 as prob, 'greedy' as kept from (select *, row_number() over (partition by grp order by score desc, item) as r from scores) where r = 1"""))
def m6_full(spark, d):
    """Softmax over all scores (no top-k), and the greedy choice of temperature 0."""
    s = V.scores(spark, d)
    every, greedy = M.top_k_softmax(s, "grp", None, 1.0), M.top_k_softmax(s, "grp", None, 0.0)
    return (every.select("grp", "item", F.round("prob", 6).alias("prob"), F.lit("all").alias("kept"))
            .unionByName(greedy.select("grp", "item", "prob", F.lit("greedy").alias("kept"))))


@query("m7_argmax", with_views(["scores"], """
select grp, item, score from (select *, row_number() over (partition by grp order by score desc, item) as r from scores)
where r = 1"""))
def m7(spark, d):
    """Greedy choice: the highest score per group, lowest item on ties."""
    return M.argmax(V.scores(spark, d), "grp")


@query("m8_sample_categorical", with_views(["scores"], f"""
select grp, coalesce(min(case when cum > u then item end), max(case when prob > 0 then item end)) as item
from (select grp, item, prob, sum(prob) over (partition by grp order by item rows between unbounded preceding and current row)
        as cum, cast(('0x' || substr(md5('{SEED}:' || grp), 1, 13)) as bigint) / {float(16 ** 13)!r} as u from topk)
group by grp""", [_TOPK_SQL]))
def m8(spark, d):
    """One item drawn per group from the top-k distribution with a seeded uniform."""
    p = M.top_k_softmax(V.scores(spark, d), "grp", TOP_K, TEMPERATURE)
    return M.sample_categorical(p, "grp", SEED)


@query("m8_race_sample", with_views(["scores"], f"""
select grp, min_by(item, [case when u = 0 then 'infinity'::double else -ln(u) / prob end, item]) as item
from (select grp, item, prob, cast(('0x' || substr(md5('{SEED}:' || grp || ':' || item), 1, 13)) as bigint) / {float(16 ** 13)!r} as u from topk) where prob > 0 group by grp""", [_TOPK_SQL]))
def m8_race(spark, d):
    """One item drawn per group from the top-k distribution by an exponential race: a partial aggregate."""
    return M.race_categorical(M.top_k_softmax(V.scores(spark, d), "grp", TOP_K, TEMPERATURE), "grp", SEED)


@query("m9_truncate_at_stop", with_views(["answered_pairs"], f"""
select conv_id, cast(len(kept) as bigint) as n_kept, array_to_string(kept, '') as text_kept from (
  select conv_id, list_slice(toks, 1, least(coalesce(nullif(list_position(toks, {q(S.EOS_TOKEN)}), 0) - 1, len(toks)),
                                            {S.MAX_NEW_TOKENS - 1})) as kept
  from (select conv_id, regexp_extract_all(a || {q(S.EOS_TOKEN)}, {TOKEN_RE}, 0) as toks from answered_pairs))"""))
def m9(spark, d):
    """Answer tokens as a generated sequence, cut at EOS and at 99 new tokens."""
    p = V.answered_pairs(spark, d)
    toks = T.tokenize(F.concat(F.col("a"), F.lit(S.EOS_TOKEN)))
    kept = M.truncate_at_stop(toks, F.lit(S.EOS_TOKEN), S.MAX_NEW_TOKENS)
    return p.select("conv_id", kept.alias("k")).select(
        "conv_id", F.size("k").cast("bigint").alias("n_kept"), F.array_join("k", "").alias("text_kept"))


_BEST_SQL = ("best", """
select run_id, step as best_step, eval_loss as best_loss from (
  select *, row_number() over (partition by run_id order by eval_loss, step) as r from metrics_log) where r = 1""")


@query("m10_best_checkpoint", with_views(["metrics_log"], "select * from best", [_BEST_SQL]))
def m10(spark, d):
    """Lowest eval loss per run; ties to the earliest step."""
    return M.best_checkpoint(V.metrics_log(spark, d))


@query("m11_retained_checkpoints", with_views(["metrics_log"], """
select run_id, step, keep, 0 as track_best, 0 as is_best from (
  select *, row_number() over (partition by run_id order by step desc) as r from metrics_log), (select unnest([1, 2]) as keep) where r <= keep
union all
select run_id, best_step as step, keep, 1 as track_best, 1 as is_best from best, (select unnest([1, 2]) as keep)
union all
select run_id, step, keep, 1 as track_best, 0 as is_best from (
  select m.run_id, m.step, row_number() over (partition by m.run_id order by m.step desc) as r, max(m.step) over (partition by m.run_id) as newest, b.best_step
  from metrics_log m join best b using (run_id) where m.step <> b.best_step), (select unnest([1, 2]) as keep)
where r = 1 and (keep = 2 or step > best_step)""", [_BEST_SQL]))
def m11(spark, d):
    """Checkpoints left after rotation, with the best one tracked (stage 3) and without (stages 1 and 2)."""
    m = V.metrics_log(spark, d)
    out = None
    for keep in (1, 2):
        for track in (False, True):
            r = M.retained_checkpoints(m, keep, track).select("run_id", "step", F.lit(keep).alias("keep"), F.lit(int(track)).alias("track_best"), "is_best")
            out = r if out is None else out.unionByName(r)
    return out
