"""Mixture language ID: held-out accuracy, the EM against a literal one, edge rows."""
import numpy as np
import pyarrow as pa

from stepcorpus.llm import language_mixture as L
from stepcorpus.sources.tables import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = L.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and len(held) > 200
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_em_against_a_literal_loop():
    rng = np.random.default_rng(0)
    like, first = rng.random((50, 3)) + 1e-3, np.array([0, 0, 20, 21, 50])
    share, fit = L.proportions(like, first, np.ones((4, 3)), steps=5)
    for d in range(4):
        x = like[first[d]:first[d + 1]]
        p = np.ones(3) / 3
        for _ in range(5 if len(x) else 0):
            p = np.mean([row * p / (row @ p) for row in x], axis=0)
        if len(x):
            assert np.allclose(share[d], p) and np.isclose(fit[d], sum(np.log(row @ p) for row in x))


def test_mixed_documents_name_more_than_one_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    langs, model = L.learn(docs)
    by = {r.lang: r.text for r in docs.filter("length(text) > 3000").collect()}
    mixed = spark.createDataFrame([(1, by["en"][:1500] + " " + by["fr"][:1000]), (2, by["en"][:1500])], "doc_id long, text string")
    got = {r.doc_id: r for r in L.predict(mixed, langs, model).collect()}
    assert got[1].lang_pred == "en" and got[1].n_langs >= 2 and 0.5 < got[1].score < 0.8
    assert got[2].lang_pred == "en" and got[2].n_langs == 1 and got[2].score > 0.9


def test_edge_rows(spark):
    rows = [(1, "the house", "en"), (2, "das haus", "de"), (3, None, "en"), (4, "", None), (5, "123 ...", "en"), (None, "x", "en"), (6, "the " * 50000, None), (6, "the", None), (8, "é", None), (9, "the house", None)]
    docs = spark.createDataFrame([(k, t, g, 1.0) for k, t, g in rows], "doc_id long, text string, lang string, score double")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert L.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in L.identify(docs.filter("lang is null")).collect()} == {"und"}  # nothing to learn from


def test_sets_of_any_size_with_their_proportions(spark):
    rng = np.random.default_rng(4)
    words = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"[5 * k % 20:5 * k % 20 + 6] + "xyz"), 6)) for _ in range(40)] for k in range(7)}
    some = lambda k, n: " ".join(rng.choice(words[f"l{k}"], n))
    docs = spark.createDataFrame([(i, some(i % 7, 300), f"l{i % 7}") for i in range(140)], "doc_id long, text string, lang string")
    langs, model = L.learn(docs)
    mixed = [(k, " ".join(some(j, 100 * (2 if j == 0 else 1)) for j in range(k))) for k in range(1, 8)] + [(8, None)]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(mixed, "doc_id long, text string"), langs, model).collect()}
    for k in range(1, 8):
        want = {f"l{j}": (2 if j == 0 else 1) / (k + 1) for j in range(k)}
        shares = {x.lang: x.share for x in got[k].languages}
        assert got[k].n_langs == k and got[k].lang_pred == "l0" == got[k].languages[0].lang and set(shares) == set(want)
        assert np.isclose(sum(shares.values()), 1) and all(abs(shares[x] - want[x]) < 0.03 for x in want)
    assert got[8].languages == [] and got[8].n_langs == 0


def test_texts_are_judged_in_slices_of_bounded_memory():
    import tracemalloc
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{x:06x}" for x in rng.integers(0, 1 << 24, 400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.binary())], ["text"])
    table = np.log(rng.random((6, L.BUCKETS))).astype(np.float32)
    tracemalloc.start()
    try:
        rows = [(lo, hi) for lo, hi, *_ in L.judge(batch, list("abcdef"), table)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows[0][0] == 0 and rows[-1][1] == len(texts) and batch.nbytes > 3 << 20
    assert peak < 40 << 20, peak
