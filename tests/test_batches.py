import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stepcorpus.functions.ranking import seeded_key, with_global_rank
from stepcorpus.operators import batches as B


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_global_rank_equals_row_number(spark, parts):
    df = spark.range(0, 500).withColumn("h", seeded_key(7, "id")).repartition(parts)
    got = with_global_rank(df, [F.col("h"), F.col("id")], "rk", total_col="n", num_partitions=parts)
    want = df.withColumn("rk", F.row_number().over(Window.orderBy("h", "id")))
    assert sorted((r.id, r.rk) for r in got.collect()) == sorted((r.id, r.rk) for r in want.collect())
    assert {r.n for r in got.select("n").collect()} == {500}


@pytest.mark.parametrize("n,val", [(0, 0), (1, 0), (19, 0), (20, 1), (100, 5), (1000, 50)])
def test_exact_split_sizes(spark, n, val):
    df = spark.range(0, n)
    s = B.exact_split(df, "id", 0.05, 42)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts.get("validation", 0) == val
    assert counts.get("train", 0) == n - val
    assert s.select("id").distinct().count() == n


def test_exact_split_repeatable_and_seeded(spark):
    df = spark.range(0, 400)
    v = lambda seed, parts: sorted(r.id for r in B.exact_split(df.repartition(parts), "id", 0.05, seed)
                                   .filter("split = 'validation'").collect())
    assert v(42, 1) == v(42, 7)
    assert v(42, 3) != v(43, 3)


def test_assign_batches_and_padding(spark):
    df = spark.range(0, 10).withColumn("ids", F.sequence(F.lit(1), F.col("id") + 1))
    b = B.assign_batches(df, "id", 4, epochs=2, seed=1)
    sizes = sorted((r.epoch, r.batch_id, r["count"]) for r in b.groupBy("epoch", "batch_id").count().collect())
    assert sizes == [(0, 0, 4), (0, 1, 4), (0, 2, 2), (1, 0, 4), (1, 1, 4), (1, 2, 2)]
    e0 = [r.id for r in b.filter("epoch = 0").orderBy("batch_id", "slot").collect()]
    e1 = [r.id for r in b.filter("epoch = 1").orderBy("batch_id", "slot").collect()]
    assert sorted(e0) == list(range(10)) and e0 != e1
    p = B.pad_to_batch_max(b, {"ids": F.lit(0).cast("bigint")}, "ids")
    lens = p.groupBy("epoch", "batch_id").agg(F.countDistinct(F.size("ids")).alias("k")).collect()
    assert all(r.k == 1 for r in lens)


def test_narrow_max_len_pads_like_the_window(spark):
    df = spark.range(0, 23).withColumn("ids", F.sequence(F.lit(1), (F.col("id") * 7) % 11 + 1))
    fill = {"ids": F.lit(0).cast("bigint")}
    via_window = B.pad_to_batch_max(B.assign_batches(df, "id", 4, epochs=2, seed=3), fill, "ids")
    narrow = B.assign_batches(df, "id", 4, epochs=2, seed=3, length_of="ids")
    via_narrow = B.pad_to_batch_max(narrow, fill, "ids", max_len="max_len")
    assert via_narrow.columns == via_window.columns
    rows = lambda d: sorted((r.epoch, r.batch_id, r.slot, r.id, tuple(r.ids)) for r in d.collect())
    assert rows(via_narrow) == rows(via_window)


def test_pad_batch_steps(spark):
    df = spark.createDataFrame([(1, [5, 6, 7], [(0, 1)]), (2, [8], None)],
                               "k long, ids array<bigint>, steps array<struct<idx:int,label:int>>")
    df = df.withColumns({"labels": F.col("ids"), "epoch": F.lit(0), "batch_id": F.lit(0)})
    out = {r.k: r for r in B.pad_batch_steps(df, "ids", "labels", F.lit(0).cast("bigint"),
                                             F.lit(-100).cast("bigint")).collect()}
    assert out[2].ids == [8, 0, 0] and out[2].labels == [8, -100, -100]
    assert out[2].attention_mask == [1, 0, 0] and out[2].steps == []
    assert out[1].attention_mask == [1, 1, 1]


def test_schedule(spark):
    b = spark.range(0, 20).select((F.col("id") % 2).alias("epoch"), (F.col("id") / 2).cast("long").alias("batch_id"),
                                  F.lit(3).alias("tok"))
    s = B.schedule(b, accum=4, log_steps=1, save_steps=3, eval_steps=None, tokens=F.col("tok"))
    rows = sorted((r.global_step, r.n_micro_batches, r.is_save) for r in s.collect())
    # 10 batches per epoch, accumulation 4 -> 3 steps per epoch (4, 4, 2)
    assert rows == [(1, 4, 0), (2, 4, 0), (3, 2, 1), (4, 4, 0), (5, 4, 0), (6, 2, 1)]
