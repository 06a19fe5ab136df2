"""Exact split, per-epoch batches, padding and the step schedule.

Ordering is always by a seeded md5 key (repeatable, identical in DuckDB)
with the row key as tie-breaker, and ranks come from the range-partitioned
global rank, never from a one-partition window.  The batch's longest row
is found on the narrow assignment rows (or, without them, by a window
partitioned by batch, which holds at most ``batch_size`` rows).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepcorpus.functions.ranking import seeded_key, with_global_rank, with_running_sum
from stepcorpus.operators.tokens import attention_mask


def exact_split(df: DataFrame, key: str, frac: float = 0.05, seed: int = 42,
                split_col: str = "split") -> DataFrame:
    """B1: exactly ``int(n * frac)`` rows go to ``validation``, the rest to
    ``train``; disjoint, complete and repeatable for a given seed.

    Only the narrow ``(key, md5)`` rows are ranked (and written by the
    rank); the assignment is joined back on ``key``, which must be unique."""
    keys = df.select(key, seeded_key(seed, key).alias("_h"))
    ranked = with_global_rank(keys, [F.col("_h"), F.col(key)], "_rank", total_col="_n")
    k = F.floor(F.col("_n").cast("double") * F.lit(float(frac)))
    assign = ranked.select(key, F.when(F.col("_rank") <= k, F.lit("validation"))
                           .otherwise(F.lit("train")).alias(split_col))
    return df.join(assign, key)


def batch_assignment(df: DataFrame, key: str, batch_size: int, epochs: int = 1, seed: int = 42,
                     length_of: str | None = None) -> DataFrame:
    """The narrow B2 table ``key, epoch, batch_id, slot``: for every epoch a
    fresh seeded order, cut into consecutive batches of ``batch_size`` (the
    last one may be short).  With ``length_of`` it also carries ``max_len``,
    the longest ``length_of`` array in the batch, computed here on one
    integer per row instead of on the full rows.

    The per-epoch orders are ranked on narrow ``(key, epoch, md5)`` rows."""
    epoch = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint")))
    extra = [F.size(length_of).alias("_len")] if length_of else []
    keys = df.select(key, *extra, epoch.alias("epoch"))
    keyed = keys.withColumn("_h", seeded_key(seed, F.col("epoch"), F.col(key)))
    ranked = with_global_rank(keyed, [F.col("epoch"), F.col("_h"), F.col(key)], "_rank", total_col="_n")
    r = F.col("_rank") - 1 - F.col("epoch") * (F.col("_n") / F.lit(epochs)).cast("bigint")
    assign = ranked.select(key, "epoch", F.floor(r / F.lit(batch_size)).cast("bigint").alias("batch_id"),
                           (r % F.lit(batch_size)).cast("int").alias("slot"), *(["_len"] if length_of else []))
    if length_of:
        assign = assign.withColumn("max_len", F.max("_len").over(Window.partitionBy("epoch", "batch_id"))).drop("_len")
    return assign


def assign_batches(df: DataFrame, key: str, batch_size: int, epochs: int = 1, seed: int = 42,
                   length_of: str | None = None) -> DataFrame:
    """B2: adds ``epoch``, ``batch_id`` (within the epoch) and ``slot`` (and
    ``max_len`` with ``length_of``, see ``batch_assignment``).  Joining the
    narrow assignment back on ``key`` (unique) gives one row per sample and
    epoch; it is the only shuffle of the full rows."""
    return df.join(batch_assignment(df, key, batch_size, epochs, seed, length_of), key)


def pad_to_batch_max(df: DataFrame, fills: dict[str, Column], length_of: str,
                     batch: tuple[str, ...] = ("epoch", "batch_id"), max_len: str | None = None) -> DataFrame:
    """Pad each array column in ``fills`` to the longest ``length_of`` in
    its batch, with that column's fill value.  ``max_len`` names a column
    that already holds that length (from ``assign_batches(length_of=...)``);
    without it a window partitioned by batch computes it."""
    if max_len:
        out = df.withColumnRenamed(max_len, "_max_len")
    else:
        out = df.withColumn("_max_len", F.max(F.size(length_of)).over(Window.partitionBy(*batch)))
    for c, fill in fills.items():
        out = out.withColumn(c, F.concat(F.col(c), F.array_repeat(fill, F.col("_max_len") - F.size(c))))
    return out.drop("_max_len")


def pad_batch_steps(df: DataFrame, ids: str, labels: str, pad_id: Column, label_fill: Column,
                    steps: str = "steps", batch: tuple[str, ...] = ("epoch", "batch_id"),
                    max_len: str | None = None) -> DataFrame:
    """Ids padded with the pad id, labels with ``label_fill`` (-100), the
    attention mask computed after padding (T12), step lists left ragged with
    a missing list made empty."""
    out = pad_to_batch_max(df, {ids: pad_id, labels: label_fill}, ids, batch, max_len)
    return out.withColumns({"attention_mask": attention_mask(F.col(ids), pad_id),
                            steps: F.coalesce(F.col(steps), F.array().cast(df.schema[steps].dataType))})


def schedule(batches: DataFrame, accum: int, log_steps: int, save_steps: int, eval_steps: int | None,
             tokens: Column) -> DataFrame:
    """Micro-batches -> optimizer steps.  Each epoch has
    ``ceil(batches / accum)`` steps (a short remainder still steps); the
    1-based global step drives the log / save / eval flags."""
    per_epoch = batches.groupBy("epoch").agg(F.max("batch_id").alias("_last"))
    steps_per_epoch = F.ceil((F.col("_last") + 1) / F.lit(accum))
    # one row per epoch: tiny, so the join is a broadcast
    j = batches.join(F.broadcast(per_epoch), "epoch")
    step = F.col("epoch") * steps_per_epoch + F.floor(F.col("batch_id") / F.lit(accum)) + 1
    agg = (j.withColumn("global_step", step.cast("bigint"))
           .groupBy("global_step")
           # the micro-batches of one step are consecutive ids of one epoch
           .agg((F.max("batch_id") - F.min("batch_id") + 1).alias("n_micro_batches"),
                F.count(F.lit(1)).alias("n_rows"), F.sum(tokens).alias("n_tokens")))
    flag = lambda every: (F.col("global_step") % F.lit(every) == 0).cast("int") if every else F.lit(0)
    return agg.withColumns({"is_log": flag(log_steps), "is_save": flag(save_steps), "is_eval": flag(eval_steps)})


# ------------------------------------------------------- B2 by a permutation

ROUNDS = 6  # of the keyed bijection
WALK = 16  # applications at most
_M31 = 2 ** 31


def round_keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """An addend and an odd factor, 28 bits each, for every round."""
    digests = [hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest() for r in range(ROUNDS)]
    return [(int(h[:7], 16), int(h[7:14], 16) | 1) for h in digests]


def _scrambled(half: Column, add: Column, factor: Column) -> Column:
    x = ((half + add) % _M31 * factor) % _M31
    x = x.bitwiseXOR(F.shiftright(x, 15)) * factor % _M31
    return x.bitwiseXOR(F.shiftright(x, 13))


def permuted(place: Column, n: Column, epoch: Column, epochs: int, seed: int, back: bool = False) -> Column:
    """A keyed bijection of [0, n), one for each epoch in [0, epochs): where ``place`` (a long) goes, or with ``back``
    where it came from.  It is computed in the row, so an epoch's order needs no sort.

    The place is written as (l, r) in an a x b rectangle, a = ceil(sqrt n), b = ceil(n / a); each round adds a
    hash of one part to the other, modulo its side, which can be undone.  A place outside [0, n), one of
    fewer than a, is sent on (a cycle walk) until it lies inside: with n places of a x b that is rarely more than
    once, and an error after ``WALK`` times."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n.cast("double") / a).cast("long")
    keys = F.get(F.array(*[F.array(*[F.struct(F.lit(r).cast("long").alias("odd"), F.lit(x).cast("long").alias("add"), F.lit(f).cast("long").alias("factor"))
                                     for r, (x, f) in (list(enumerate(round_keys(seed, e)))[::-1] if back else enumerate(round_keys(seed, e)))]) for e in range(epochs)]), epoch.cast("int"))
    sign = -1 if back else 1

    def one_round(s: Column, k: Column) -> Column:
        odd = k["odd"] % 2 == 1
        step = _scrambled(F.when(odd, s["l"]).otherwise(s["r"]), k["add"], k["factor"]) * sign
        return F.struct(F.when(odd, s["l"]).otherwise(F.pmod(s["l"] + step, a)).alias("l"), F.when(odd, F.pmod(s["r"] + step, b)).otherwise(s["r"]).alias("r"))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(keys, start, one_round, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), place.cast("long"), lambda x, i: F.when((i > 0) & (x < n), x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk did not end")))


def permuted_batches(df: DataFrame, key: str, batch_size: int, epochs: int = 1, seed: int = 42) -> DataFrame:
    """B2 without a sort an epoch: ``key, epoch, batch_id, slot``.  Keys are ranked once; each epoch's order is the keyed
    bijection of the ranks.  ``batch_ranks`` gives the ranks of any batch without the others, for a resumed run."""
    ranked = with_global_rank(df.select(key), [F.col(key)], "_rank", total_col="_n")
    each = ranked.select(key, (F.col("_rank") - 1).cast("long").alias("_rank"), F.col("_n").cast("long").alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))).alias("epoch"))
    place = each.withColumn("_place", permuted(F.col("_rank"), F.col("_n"), F.col("epoch"), epochs, seed))
    return place.select(key, "epoch", F.floor(F.col("_place") / batch_size).cast("long").alias("batch_id"), (F.col("_place") % batch_size).cast("int").alias("slot"))


def batch_ranks(spark: SparkSession, n: int, epoch: int, batch_id: int, batch_size: int, seed: int = 42) -> DataFrame:
    """``slot, rank`` (from 0, in the order of the keys) of one batch of ``permuted_batches`` over n keys."""
    first = batch_id * batch_size
    places = spark.range(first, max(first, min(n, first + batch_size)))
    rank = permuted(F.col("id"), F.lit(n).cast("long"), F.lit(epoch), epoch + 1, seed, back=True)
    return places.select((F.col("id") % batch_size).cast("int").alias("slot"), rank.alias("rank"))


# ------------------------------------------------------- S5 by token counts

def token_shards(df: DataFrame, key: str, n_tokens: str, shard_tokens: int, seed: int = 42) -> DataFrame:
    """``key, shard, before``: samples in a seeded order cut into total // ``shard_tokens`` shards (at least one) of equal
    token counts; a sample belongs to the shard in which its first token falls, so a shard's count differs from
    the mean by less than its longest sample.  ``before`` is the number of tokens before it.  A running sum over
    range partitions finds the bounds; nulls count as no tokens."""
    narrow = df.select(key, F.coalesce(F.col(n_tokens), F.lit(0)).cast("long").alias("_t")).withColumn("_h", seeded_key(seed, key))
    placed = with_running_sum(narrow, [F.col("_h"), F.col(key)], "_t", "before", "_total")
    shards = F.greatest(F.floor(F.col("_total") / shard_tokens), F.lit(1))
    shard = F.floor(F.col("before").cast("double") * shards / F.greatest(F.col("_total"), F.lit(1)))
    return placed.select(key, F.least(shard, shards - 1).cast("long").alias("shard"), F.col("before").cast("long").alias("before"))
