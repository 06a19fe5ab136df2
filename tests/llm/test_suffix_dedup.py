"""Repeated strings: every window counted, the merge, hot anchors, edge rows."""
import random

import numpy as np

from stepcorpus.llm import suffix_dedup as S
from stepcorpus.sources.tables import table


def result(docs, **o):
    return sorted((tuple(r) for r in S.remove_repeats(docs, **o).collect()), key=str)


def literal(rows, length=S.LENGTH):
    return sorted(S.brute_force(rows, length), key=str)


def test_given_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = literal([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs) == want and any(r[2] for r in want)


def made(rng, n):
    """Texts of few letters: copies, edits, passages at all kinds of places, periods, ties."""
    chars = "ab c\né"
    block = lambda k: "".join(rng.choice(chars) for _ in range(k))
    passages = [block(rng.randrange(60, 240)) for _ in range(4)] + ["ab" * 90, "x" * 150]
    texts = []
    for _ in range(n):
        t = "".join(rng.choice([block(rng.randrange(80)), rng.choice(passages)]) for _ in range(rng.randrange(6)))
        texts.append(t)
        if rng.random() < .3:
            t = list(t)
            for _ in range(rng.randrange(3)):
                if t:
                    t[rng.randrange(len(t))] = "q"
            texts.append("".join(t))
    return texts


def test_random_texts(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, t) for i, t in enumerate(made(rng, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = literal(rows, 100)
    assert result(docs, length=100) == want
    monkeypatch.setattr(S, "PAIRWISE", 1)
    assert result(docs, length=100) == want
    monkeypatch.setattr(S, "HOT", 2)
    assert result(docs, length=100) == want


def test_merge_is_a_sort_with_common_prefixes():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(8))), bytes([i]), i, 0) for i in range(rng.randrange(20))) for _ in range(k)]
        got = list(S.merge([S.write_run(r) for r in runs]))
        assert [e[0] for _, e in got] == sorted(e[0] for r in runs for e in r)
        assert sorted(e for _, e in got) == sorted(e for r in runs for e in r)
        for (_, (a, *_)), (n, (b, *_)) in zip(got, got[1:]):
            assert n == S.common(a, b)


def test_long_text_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    whole = S.anchors_of(data, np.array([0, 5000]), 100)
    monkeypatch.setattr(S, "PIECE", 200)
    assert (S.anchors_of(data, np.array([0, 5000]), 100) == whole).all()


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, "y" * 400), (5, "z" * 401), (6, "pq" * 3000), (7, "ä" * 300), (8, "ä" * 300), (None, "n" * 400), (None, "n" * 400), (9, "r" * 50), (9, "r" * 50)]
    docs = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, n_removed int")
    assert result(docs) == literal(rows)
    assert S.remove_repeats(docs.limit(0)).collect() == []
    kept = {r.doc_id: bytes(r.kept) for r in S.remove_repeats(docs, texts=True).collect()}
    assert kept[4] == b"y" * 400 and kept[6] == b""


def test_tasks_hold_bounded_pieces(spark, monkeypatch):
    """Texts come to Python in bounded batches, anchors are sought in small pieces and runs are written by bytes."""
    from stepcorpus.session import BATCH_BYTES
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = [(i, t) for i, t in enumerate(made(random.Random(5), 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    try:
        spark.conf.set(key, "1g")
        S.remove_repeats(docs.limit(0))
        assert int(spark.conf.get(key)) == BATCH_BYTES
        monkeypatch.setattr(S, "RUN_BYTES", 2000)  # many runs a task
        assert result(docs, length=100) == literal(rows, 100)
    finally:
        spark.conf.set(key, before)


def test_memory_of_anchors_does_not_follow_the_batch():
    import tracemalloc
    import pyarrow as pa
    texts = [bytes(x) for x in np.random.default_rng(3).integers(97, 123, (1500, 4000)).astype(np.uint8)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    S.prefix_hash(np.zeros(S.PIECE, np.uint8))  # the powers are kept
    tracemalloc.start()
    try:
        for _, _, data, at in S.slices(batch, "text", S.PIECE):
            S.anchors_of(data, at)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()
