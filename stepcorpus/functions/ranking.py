"""Exact global ranks without funnelling rows through one partition.

``row_number()`` over an un-partitioned window moves every row into a single
task.  Here the rows are range-partitioned on the sort key instead, each task
numbers its own rows in order, and a tiny table of per-partition counts
(one row per partition, so its size is bounded by the partition count, not by
the data) supplies the offsets.  The sort key must be unique (add the row id
as a last tie-breaker).

The tagged rows (partition id, position in the task) are written once to
the shared checkpoint folder and both the counts and the ranks are read from
that table.  Two separate range exchanges would each sample their own range
bounds (the sample seed depends on the RDD), so their partition ids need not
agree; one written table makes the numbers consistent by construction and
survives executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def with_global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank",
                     total_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based rank in ``order`` (and optionally the total row count)."""
    from stepcorpus.session import materialize
    n = _partitions(df, num_partitions)
    tagged = materialize(df.repartitionByRange(n, *order)
                         .sortWithinPartitions(*order)
                         .withColumn("_rk_pid", F.spark_partition_id())
                         .withColumn("_rk_mid", F.monotonically_increasing_id()), "ranked")
    counts = tagged.groupBy("_rk_pid").agg(F.count(F.lit(1)).alias("_rk_n"),
                                           F.min("_rk_mid").alias("_rk_m0"))
    before = Window.orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_rk_pid", "_rk_m0",
        F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_off"),
        F.sum("_rk_n").over(Window.partitionBy()).alias("_rk_total"))
    out = (tagged.join(F.broadcast(offsets), "_rk_pid")
           .withColumn(rank_col, F.col("_rk_off") + F.col("_rk_mid") - F.col("_rk_m0") + F.lit(1)))
    if total_col:
        out = out.withColumnRenamed("_rk_total", total_col)
    return out.drop("_rk_pid", "_rk_mid", "_rk_m0", "_rk_off", "_rk_n", "_rk_total")


def with_running_sum(df: DataFrame, order: Sequence[Column], value: str, before: str = "before", total: str = "total",
                     num_partitions: int | None = None) -> DataFrame:
    """Add the sum of ``value`` over all rows earlier in ``order`` (unique) and the sum over all rows, the way
    ``with_global_rank`` numbers them: tasks sum their own rows, a row a task gives the offsets.  Meant for
    narrow rows, which are written once."""
    from stepcorpus.session import materialize
    n = _partitions(df, num_partitions)
    tagged = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_rs_pid", F.spark_partition_id()).withColumn("_rs_mid", F.monotonically_increasing_id()), "summed")
    earlier = Window.orderBy("_rs_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    sums = tagged.groupBy("_rs_pid").agg(F.sum(value).alias("_rs_sum"))
    sums = sums.select("_rs_pid", F.coalesce(F.sum("_rs_sum").over(earlier), F.lit(0)).alias("_rs_off"), F.sum("_rs_sum").over(Window.partitionBy()).alias(total))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_rs_pid").orderBy("_rs_mid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one task's rows
    return (tagged.withColumn("_rs_in", inside).join(F.broadcast(sums), "_rs_pid")
            .withColumn(before, F.col("_rs_off") + F.col("_rs_in")).drop("_rs_pid", "_rs_mid", "_rs_in", "_rs_off"))


def seeded_key(seed: int | str, *parts: Column | str) -> Column:
    """md5 of ``seed:part1:part2…`` as hex text: a repeatable shuffle key
    that DuckDB computes identically."""
    cols = [F.lit(str(seed))] + [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def seeded_uniform(seed: int | str, *parts: Column | str) -> Column:
    """A uniform number in [0, 1) from the first 13 hex digits of the md5 key."""
    h = F.substring(seeded_key(seed, *parts), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(16 ** 13))
