"""Keyed permutations, balanced shards, batch-wide scatter, race sampling, id batches."""
import math
import random

import pytest
from pyspark.sql import functions as F

from stepcorpus.operators import batches as B
from stepcorpus.operators import features as J
from stepcorpus.operators import scoring as M
from stepcorpus.sources import files as SRC


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 99, 100, 101, 997, 5000])
def test_every_epoch_is_a_bijection_and_its_inverse(spark, n):
    rows = spark.range(n).crossJoin(spark.range(3).withColumnRenamed("id", "epoch"))
    out = rows.withColumn("to", B.permuted(F.col("id"), F.lit(n).cast("long"), F.col("epoch"), 3, 42))
    out = out.withColumn("back", B.permuted(F.col("to"), F.lit(n).cast("long"), F.col("epoch"), 3, 42, back=True)).collect()
    assert all(r.back == r.id for r in out)
    orders = []
    for e in range(3):
        orders.append([r.to for r in sorted(out, key=lambda r: r.id) if r.epoch == e])
        assert sorted(orders[-1]) == list(range(n))
    if n > 50:
        assert orders[0] != orders[1] and orders[1] != orders[2] and orders[0] != list(range(n))
        x = orders[0]  # neighbours are spread: no more rises than chance gives
        rises = sum(b > a for a, b in zip(x, x[1:]))
        assert abs(rises - (n - 1) / 2) < 4 * math.sqrt(n)


def test_batches_and_a_resumed_batch(spark):
    keys = [f"k{i:03}" for i in range(103)]
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)
    got = B.permuted_batches(df, "key", 10, 2, 7).collect()
    assert len(got) == 206
    for e in range(2):
        by = {}
        for r in got:
            if r.epoch == e:
                by.setdefault(r.batch_id, {})[r.slot] = r.key
        assert sorted(k for b in by.values() for k in b.values()) == keys and [len(by[b]) for b in sorted(by)] == [10] * 10 + [3]
        for b in (0, 4, 10):
            assert {r.slot: keys[r.rank] for r in B.batch_ranks(spark, 103, e, b, 10, 7).collect()} == by[b]
    assert B.batch_ranks(spark, 103, 0, 11, 10, 7).count() == 0
    assert B.permuted_batches(df.filter("false"), "key", 10, 2, 7).count() == 0


def test_shards_differ_by_less_than_two_samples(spark, tmpdir_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 80]), f"text {i}") for i in range(600)] + [(600, None, "null")]
    df = spark.createDataFrame(rows, "k long, n long, t string").repartition(4)
    manifest = SRC.write_balanced_shards(df, f"{tmpdir_path}/s", "k", "n", 1500).collect()
    total = sum(n or 0 for _, n, _ in rows)
    assert sorted(r.shard for r in manifest) == list(range(total // 1500))
    assert sum(r.n_rows for r in manifest) == 601 and sum(r.n_tokens or 0 for r in manifest) == total
    assert max(r.n_tokens for r in manifest) - min(r.n_tokens for r in manifest) <= 2 * 80
    back = spark.read.parquet(f"{tmpdir_path}/s").collect()
    assert sorted((r.k, r.n, r.t) for r in back) == sorted(rows)
    again = {r.shard: r.checksum for r in SRC.shard_manifest(spark, f"{tmpdir_path}/s", "k", "n").collect()}
    assert again == {r.shard: r.checksum for r in manifest}
    few = B.token_shards(df.limit(3), "k", "n", 10 ** 9).collect()
    assert {r.shard for r in few} == {0} and B.token_shards(df.filter("false"), "k", "n", 5).count() == 0


def test_a_surplus_of_features_goes_on_to_the_next_sample(spark):
    samples = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 0, 2), ("d", 1, 0)], "s string, batch long, slot int")
    pads = spark.createDataFrame([("a", 0, 4), ("a", 1, 5), ("b", 0, 1), ("b", 1, 2), ("b", 2, 3), ("d", 0, 9)], "s string, k int, pos int")
    features = spark.createDataFrame([("a", i, f"a{i}") for i in range(3)] + [("c", 5, "c5"), ("c", 9, "c9"), ("d", 0, "d0"), ("d", 1, "d1")], "image_id string, patch_idx int, v string")
    got = {(r.s, r.pos): (r.n, r.v) for r in J.scatter_features_in_batch(pads, features, samples, "s", "batch", "slot").collect()}
    assert got == {("a", 4): (0, "a0"), ("a", 5): (1, "a1"), ("b", 1): (2, "a2"), ("b", 2): (3, "c5"), ("b", 3): (4, "c9"), ("d", 9): (0, "d0")}


def test_the_race_draws_by_probability(spark):
    p = {0: 0.5, 1: 0.3, 2: 0.2, 3: 0.0}
    probs = spark.range(6000).withColumnRenamed("id", "grp").crossJoin(spark.createDataFrame(list(p.items()), "item long, prob double"))
    drawn = M.race_categorical(probs, "grp", 11)
    counts = {r.item: r["count"] for r in drawn.groupBy("item").count().collect()}
    assert sum(counts.values()) == 6000 and 3 not in counts
    assert all(abs(counts[i] - 6000 * p[i]) < 4 * math.sqrt(6000 * p[i]) for i in (0, 1, 2))
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, M.race_categorical(probs.repartition(7), "grp", 11).collect()))
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_id_batches_take_their_lengths_from_the_assignment(spark):
    from stepcorpus.plans.stage_queries import S, id_batches
    samples = spark.createDataFrame([(i, list(range(1, i + 2)), [7] * (i + 1)) for i in range(37)], "conv_id long, input array<long>, labels array<long>")
    out = id_batches(samples, S.STAGE1)
    by = {}
    for r in out.collect():
        by.setdefault(r.batch_id, []).append(r)
        assert r.input[:r.conv_id + 1] == list(range(1, r.conv_id + 2)) and set(r.input[r.conv_id + 1:]) <= {0} and r.labels == [7] * (r.conv_id + 1) + [0] * (len(r.input) - r.conv_id - 1)
    assert sorted(len(v) for v in by.values()) == [5, 16, 16]
    assert all({len(r.input) for r in v} == {max(r.conv_id for r in v) + 1} for v in by.values())
