import math

import numpy as np
from pyspark.sql import functions as F

from stepcorpus.operators import features as J
from stepcorpus.operators import scoring as M


def brute_head(x, wd, bd, wc, bc):
    h = [sum(wd[o][i] * x[i] for i in range(len(x))) + bd[o] for o in range(len(bd))]
    h = [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in h]
    mu = sum(h) / len(h)
    var = sum((v - mu) ** 2 for v in h) / len(h)
    h = [(v - mu) / math.sqrt(var + 1e-5) for v in h]
    return [sum(wc[c][i] * h[i] for i in range(len(h))) + bc[c] for c in range(2)]


def test_score_steps_matches_brute_force(spark):
    d = 6
    wd, bd = J.rule_matrix(d, d, 0.15, 0.37), J.rule_vector(d, 0.01, 0.9)
    wc, bc = J.rule_matrix(2, d, 0.3, 0.11), J.rule_vector(2, 0.05, 2.0)
    data = [(i, [math.sin(i + k) for k in range(d)]) for i in range(30)]
    df = spark.createDataFrame(data, "k long, v array<double>").repartition(4)
    got = {r.k: r for r in M.score_steps(df, "v", wd, bd, wc, bc).collect()}
    for k, x in data:
        l0, l1 = brute_head(x, wd, bd, wc, bc)
        assert abs(got[k].logit_0 - l0) < 1e-9 and abs(got[k].logit_1 - l1) < 1e-9
        assert abs(got[k].p_correct - 1 / (1 + math.exp(l0 - l1))) < 1e-9


def test_fit_step_verifier(spark):
    rows = [(i, [float(i % 2), 1.0 - (i % 2)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    model, data = M.fit_step_verifier(df, "embedding", "label")
    acc = model.transform(data).filter(F.col("prediction") == F.col("label")).count() / 40
    assert acc == 1.0


def test_top_k_ties_and_small_groups(spark):
    s = spark.createDataFrame([(1, 0, 3.0), (1, 1, 2.0), (1, 2, 2.0), (1, 3, 1.0), (2, 0, 5.0)],
                              "grp long, item long, score double")
    out = M.top_k_softmax(s, "grp", k=2, temperature=0.7).collect()
    g1 = {r.item: r.prob for r in out if r.grp == 1}
    assert set(g1) == {0, 1, 2}  # tie at the 2nd score kept
    assert abs(sum(g1.values()) - 1) < 1e-12
    e = np.exp(np.array([3.0, 2.0, 2.0]) / 0.7 - 3.0 / 0.7)
    assert abs(g1[0] - e[0] / e.sum()) < 1e-12
    assert [r.prob for r in out if r.grp == 2] == [1.0]  # k above the group size


def test_argmax_and_sampling(spark):
    s = spark.createDataFrame([(1, 4, 2.0), (1, 2, 2.0), (1, 0, 1.0)], "grp long, item long, score double")
    assert [tuple(r) for r in M.argmax(s, "grp").collect()] == [(1, 2, 2.0)]
    p = spark.createDataFrame([(g, i, 0.25) for g in range(200) for i in range(4)], "grp long, item long, prob double")
    a = {r.grp: r.item for r in M.sample_categorical(p, "grp", 42).collect()}
    b = {r.grp: r.item for r in M.sample_categorical(p.repartition(5), "grp", 42).collect()}
    assert a == b and len(a) == 200 and len(set(a.values())) == 4
    c = {r.grp: r.item for r in M.sample_categorical(p, "grp", 7).collect()}
    assert c != a


def test_truncate_at_stop(spark):
    df = spark.createDataFrame([([9, 1, 2],), ([1, 2, 3],), (list(range(10, 210)),), ([1, 9, 9],)], "t array<int>")
    got = [r[0] for r in df.select(M.truncate_at_stop(F.col("t"), F.lit(9), 100)).collect()]
    assert got == [[], [1, 2, 3], list(range(10, 109)), [1]]


def test_losses(spark):
    scores = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 0.0), (1, 1, 0.0), (2, 0, 5.0), (2, 1, 1.0)],
                                   "grp long, item long, score double")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "grp long, label long, batch long")
    gen = {r.batch: r for r in M.token_nll(scores, labels, "grp", "batch", ignore=0).collect()}
    want0 = math.log(math.exp(1) + math.exp(2)) - 2.0  # grp 1 ignored (label 0)
    assert gen[0].n_tokens == 1 and abs(gen[0].gen_loss - want0) < 1e-12
    assert [gen[b].n_unmatched for b in (0, 1)] == [0, 0]
    odd = spark.createDataFrame([(0, 7, 0), (9, 1, 0)], "grp long, label long, batch long")  # no such item; no scores
    lost = {r.batch: (r.n_tokens, r.n_unmatched) for r in M.token_nll(scores, odd, "grp", "batch", ignore=0).collect()}
    assert lost == {0: (0, 2), None: (0, 2)}  # positions 1 and 2 have no label
    steps = spark.createDataFrame([(0, 0.0, 1.0, 1), (0, 2.0, 0.0, 1), (3, 0.0, 0.0, 0)],
                                  "batch long, l0 double, l1 double, label int")
    ver = {r.batch: r for r in M.verification_nll(steps, "batch", "l0", "l1", "label").collect()}
    w = (math.log(1 + math.e) - 1 + math.log(math.exp(2) + 1) - 0) / 2
    assert abs(ver[0].ver_loss - w) < 1e-12
    comb = {r.batch: r.total_loss for r in M.combined_loss(
        spark.createDataFrame([(0, 1.0), (1, None), (2, 0.5)], "batch long, gen_loss double"),
        spark.createDataFrame([(0, 2.0), (3, 4.0)], "batch long, ver_loss double"), "batch").collect()}
    assert comb == {0: 3.0, 1: None, 2: 0.5, 3: 4.0}


def test_checkpoints(spark):
    m = spark.createDataFrame([(1, 2000, 0.5), (1, 4000, 0.3), (1, 6000, 0.3), (1, 8000, 0.9), (1, 10000, 0.8),
                               (2, 2000, 0.1), (3, 2000, 0.9), (3, 4000, 0.1)],
                              "run_id long, step long, eval_loss double")
    best = {r.run_id: (r.best_step, r.best_loss) for r in M.best_checkpoint(m).collect()}
    assert best == {1: (4000, 0.3), 2: (2000, 0.1), 3: (4000, 0.1)}  # tie -> earliest
    keep2 = sorted(tuple(r) for r in M.retained_checkpoints(m, 2).collect())
    assert keep2 == [(1, 4000, 1), (1, 10000, 0), (2, 2000, 1), (3, 2000, 0), (3, 4000, 1)]
    keep1 = sorted(tuple(r) for r in M.retained_checkpoints(m, 1).collect())
    assert keep1 == [(1, 4000, 1), (1, 10000, 0), (2, 2000, 1), (3, 4000, 1)]


def test_rotation_without_best_tracking(spark):
    m = spark.createDataFrame([(1, 100, 0.1), (1, 200, 0.5), (1, 300, 0.9)], "run_id long, step long, eval_loss double")
    assert [tuple(r) for r in M.retained_checkpoints(m, 1, track_best=False).collect()] == [(1, 300, 0)]
    assert sorted(r.step for r in M.retained_checkpoints(m, 2, track_best=False).collect()) == [200, 300]


def test_softmax_without_k_and_temperature_zero(spark):
    s = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, 3.0)], "grp long, item long, score double")
    every = {r.item: r.prob for r in M.top_k_softmax(s, "grp", None, 1.0).collect()}
    assert set(every) == {0, 1, 2} and abs(sum(every.values()) - 1) < 1e-9
    assert [(r.item, r.prob) for r in M.top_k_softmax(s, "grp", 2, 0).collect()] == [(1, 1.0)]


def test_top_k_temperatures(spark):
    import pytest
    s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([2.0, 1.0, 0.5, -1.0])],
                              "grp long, item long, score double")
    for temp in (0.7, 1.0):
        got = {r.item: r.prob for r in M.top_k_softmax(s, "grp", k=3, temperature=temp).collect()}
        e = np.exp(np.array([2.0, 1.0, 0.5]) / temp)
        assert set(got) == {0, 1, 2}
        assert [got[i] for i in range(3)] == pytest.approx(list(e / e.sum()), rel=1e-12)


def test_erf_of_whole_arrays():
    import math
    x = np.concatenate([np.linspace(-7, 7, 40_001), [0.0, -0.0, 1e-300, 5.9999, 6.0, 30.0, np.inf, -np.inf]])
    want = np.array([math.erf(v) for v in x])
    assert np.abs(M.erf_of(x) - want).max() < 1e-15
    assert np.isnan(M.erf_of(np.array([np.nan]))).all()


def test_optimality_certificate(spark):
    rng = np.random.default_rng(5)
    x, true = rng.normal(size=(400, 4)), np.array([1.0, -2.0, 0.5, 0.0])
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ true + 0.3)))).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "f array<double>, y int").repartition(5)
    for reg in (0.0, 0.05):
        model, _ = M.fit_step_verifier(df, "f", "y", max_iter=300, reg=reg, standardization=False, tol=1e-12)
        w, b = model.coefficients.toArray(), float(model.intercept)
        got = M.optimality(df, "f", "y", w, b, reg).orderBy("feature").collect()
        p = 1 / (1 + np.exp(-(x @ w + b)))
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + reg / 2 * w @ w
        curve = np.append((p * (1 - p)) @ (x * x) / 400 + reg, (p * (1 - p)).mean())
        assert max(abs(r.gradient) for r in got) < 1e-5
        assert np.allclose([r.curvature for r in got], curve) and np.allclose([r.loss for r in got], loss)
        assert {(r.n, r.n_pos) for r in got} == {(400, int(y.sum()))}
        off = M.optimality(df, "f", "y", w + np.array([0.1, 0, 0, 0]), b, reg).orderBy("feature").collect()
        assert abs(off[0].gradient) > 1e-3 and off[0].loss > got[0].loss


def test_ragged_loss_is_by_step_not_by_sample(spark):
    samples = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "d")], "batch long, s string")
    rows = [(0, "a", 1.0, 0.0, 1), (0, "a", 0.0, 2.0, 1), (0, "a", 0.5, 0.5, 0), (0, "b", -1.0, 1.0, 0)]
    got = {r.batch: r for r in M.ragged_verification_nll(samples, spark.createDataFrame(rows, "batch long, s string, l0 double, l1 double, y int"), ["batch"], "s", "l0", "l1", "y").collect()}
    nll = [float(np.logaddexp(l0, l1) - (l1 if y else l0)) for _, _, l0, l1, y in rows]
    assert (got[0].n_samples, got[0].n_with_steps, got[0].n_steps) == (3, 2, 4)
    assert abs(got[0].ver_loss - np.mean(nll)) < 1e-12 and abs(got[0].sample_mean - np.mean([np.mean(nll[:3]), nll[3]])) < 1e-12
    assert abs(got[0].ver_loss - got[0].sample_mean) > 0.1
    assert (got[1].n_samples, got[1].n_steps, got[1].ver_loss) == (1, 0, None)
