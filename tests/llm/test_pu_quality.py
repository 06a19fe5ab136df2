"""Positive-unlabelled quality: held-out accuracy, the prior, features against a recount, edge rows."""
import numpy as np

from stepcorpus.llm import pu_quality as Q
from stepcorpus.sources.tables import table


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = Q.score(docs, labels).collect()
    held = [(r, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == docs.count() and len(held) > 500
    for quality in (0, 1):
        assert np.mean([r.predicted == q for r, q in held if q == quality]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, 20000), np.concatenate([rng.normal(1, 1, 14000), rng.normal(-3, 1, 6000)])
    bins = np.linspace(-8, 8, Q.BINS + 1)
    assert abs(Q.estimate_prior(np.histogram(p, bins)[0], np.histogram(u, bins)[0]) - 0.7) < 0.05


def test_risk_ignores_negative_labels_and_separates():
    rng = np.random.default_rng(2)
    side = lambda n, m: np.hstack([rng.normal(m, 1, (n, 2)), np.ones((n, 1))])
    w = Q.fit(side(2000, 2), np.vstack([side(3000, 2), side(1000, -2)]), 0.75)
    assert (side(500, 2) @ w > 0).mean() > 0.95 and (side(500, -2) @ w < 0).mean() > 0.95


def test_features_of_repeats():
    texts = [b"", b"a a a b", b"x", b"a a a b"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    x = Q.shape_features(data, at)
    assert not x[0].any() and (x[1] == x[3]).all()
    assert np.allclose(x[1][-4:], [0.1, 0.5, 0.5, 0.5])


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", None), (3, "w " * 50000, 1.0), (3, "again", 1.0), (None, "x", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.score(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in Q.score(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.score(docs.limit(0), labels).collect() == []
