"""Exact top-k search against a literal one: ties, repeated ids, odd vectors, large numbers, many tiles."""
import random

from stepcorpus.llm import top_k as K
from stepcorpus.sources.tables import table


def found(df, **options):
    return sorted(tuple(r) for r in K.search(df, **options).collect())


def made(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}")


def test_given_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert found(df) == K.brute_force([(r.vec_id, r.embedding) for r in df.collect()])


def test_many_tiles_and_a_third_of_the_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 16)
    monkeypatch.setattr(K, "BLOCK_ROWS", 5)
    monkeypatch.setattr(K, "FAN", 3)
    rng = random.Random(3)
    rows = [(i, [0.5, -0.25, 0.125] if i % 3 == 0 else [rng.randrange(-8, 8) / 16 for _ in range(3)]) for i in range(400)]
    rng.shuffle(rows)
    assert found(made(spark, rows).repartition(5)) == K.brute_force(rows)
    assert found(made(spark, rows), k=1, every=7) == K.brute_force(rows, 1, 7)


def test_pieces_of_a_tile_are_merged(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.5)) for _ in range(4)]) for i in range(300)]
    piece, K.PIECE = K.PIECE, (3, 7)
    try:
        got = K._tile(5)  # the same tile cut into pieces, in this process
        import pyarrow as pa
        t = pa.table({"row": list(range(300)), "vec_id": [r[0] for r in rows], "vector": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
        hits = got((pa.scalar(0), pa.scalar(0)), t.filter(pa.compute.equal(pa.compute.bit_wise_and(t["vec_id"], 63), 0)), t).to_pylist()
    finally:
        K.PIECE = piece
    want = K.brute_force(rows, 5, 64)
    by = {}
    for h in hits:
        by.setdefault(h["query_id"], []).append((-h["score"], h["vec_id"]))
    assert sorted((q, n + 1, v, -s) for q, l in by.items() for n, (s, v) in enumerate(sorted(l)[:5])) == want


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, []), (300, [0.5]), (7, [0.0039, -0.0039]),
            (8, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [9.0, 9.0]), (350, [-1.0, -1.0, 3.0]), (0, [1.0, 2.0]), (-50, [0.25, 0.25])]
    assert found(made(spark, rows)) == K.brute_force(rows)
    assert found(made(spark, rows).selectExpr("vec_id", "embedding", "1 as row", "2 as shard", "'x' as vector", "3 as score")) == K.brute_force(rows)
    assert found(made(spark, [])) == []
    assert found(made(spark, [(0, [1.0])])) == []  # no other row


def test_numbers_beyond_floats(spark):
    rows = [(0, [1e15, 1.0, 0.5]), (1, [1e15, 1.0, 0.25]), (2, [1e15, 1.0, 0.5]), (3, [-1e15, 3.0, 0.0]), (50, [1e300, -1e300, 1.0]), (4, [2.0 ** 40, 1.0, 1.0]), (5, [0.0, 1.0, 0.0])]
    assert found(made(spark, rows, "array<double>")) == K.brute_force(rows)


def test_long_vectors(spark):
    rng = random.Random(5)
    rows = [(i * 25, [rng.random() - 0.5 for _ in range(20_000 if i % 4 else 3)]) for i in range(12)]
    assert found(made(spark, rows, "array<double>")) == K.brute_force(rows)
