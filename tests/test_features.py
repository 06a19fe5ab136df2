import numpy as np
from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.operators import features as J


def patches_df(spark, counts, d=4):
    rows = []
    for img, n in enumerate(counts):
        for p in range(n):
            rows.append((img, p, [float(img * 100 + p * 10 + k) for k in range(d)]))
    return spark.createDataFrame(rows, "image_id long, patch_idx int, embedding array<float>")


def test_regroup_divisible_and_not(spark):
    g = {(r.image_id, r.group_idx): r for r in J.regroup_patches(patches_df(spark, [6, 4]), 3).collect()}
    assert g[(0, 0)].status == "ok" and g[(0, 0)].vector == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]
    assert g[(0, 1)].vector[:4] == [30, 31, 32, 33]
    assert g[(1, 0)].status == "not_divisible" and g[(1, 0)].vector is None


def test_pool_matches_numpy(spark):
    df = patches_df(spark, [5, 1])
    got = {r.image_id: r.pooled for r in J.pool_patches(df).collect()}
    for img, n in enumerate([5, 1]):
        x = np.array([[img * 100 + p * 10 + k for k in range(4)] for p in range(n)], dtype=float)
        want = np.concatenate([x[0], x.mean(axis=0), x.max(axis=0)])
        assert np.allclose(got[img], want)


def test_project_matches_numpy(spark):
    w1, b1 = J.rule_matrix(3, 4, 0.1, 0.7), J.rule_vector(3, 0.01, 1.0)
    w2, b2 = J.rule_matrix(2, 3, 0.2, 0.3), J.rule_vector(2, 0.01, 0.5)
    df = spark.createDataFrame([(i, [float(i), 1.0, -2.0, 0.5]) for i in range(20)], "k long, v array<double>")
    got = {r.k: r.projected for r in J.project(df.repartition(3), "v", w1, b1, w2, b2, "silu").collect()}
    for i in range(20):
        x = np.array([i, 1.0, -2.0, 0.5])
        h = x @ w1.T + b1
        h = h / (1 + np.exp(-h))
        assert np.allclose(got[i], h @ w2.T + b2)


def test_scatter_and_first_pad(spark):
    pad = S.IMAGE_PAD
    arr = spark.createDataFrame([(0, ["a", pad, "b", pad, pad]), (1, ["x"]), (2, [pad, pad])],
                                "sample_id long, toks array<string>")
    pads = J.pad_ordinals(arr, "sample_id", "toks", F.lit(pad))
    assert sorted(tuple(r) for r in pads.collect()) == [(0, 0, 1), (0, 1, 3), (0, 2, 4), (2, 0, 0), (2, 1, 1)]
    feats = patches_df(spark, [2, 0, 3])  # image 0 has fewer patches than pads
    sc = {(r.sample_id, r.k): r.patch_idx for r in J.scatter_features(pads, feats, "sample_id").collect()}
    assert sc[(0, 0)] == 0 and sc[(0, 1)] == 1 and sc[(0, 2)] is None and sc[(2, 1)] == 1
    pooled = J.pool_patches(feats)
    firsts = arr.select("sample_id", J.first_pad(F.col("toks"), F.lit(pad)).alias("first_pad"))
    ins = {r.sample_id: (r.first_pad, r.pooled is not None) for r in J.insert_first_pad(firsts, pooled, "sample_id").collect()}
    assert ins == {0: (1, True), 1: (-1, False), 2: (0, True)}


def test_lookup(spark):
    toks = spark.createDataFrame([(0, 0, 5), (0, 1, 99), (0, 2, 3000), (0, 3, 3001), (0, 4, None)],
                                 "sample_id long, pos int, token_id long")
    cb = spark.createDataFrame([(5, [1.0, 2.0]), (3000, [3.0])], "vec_id long, embedding array<float>")
    for head in (J.HEAD_IDS, 0, 10_000):
        got = {r.pos: r.vector for r in J.lookup_embeddings(toks, cb, head=head).collect()}
        assert got == {0: [1.0, 2.0], 1: None, 2: [3.0], 3: None, 4: None}
