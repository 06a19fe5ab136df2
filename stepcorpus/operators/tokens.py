"""Tokens, vocabulary, labels and masks.

Per-row work (concatenation, masks, spans, shifts) uses array functions, so
it runs where the row is, without a shuffle.  Only the vocabulary needs
shuffles: counting tokens (partial aggregation absorbs Zipf-skewed hot
tokens) and numbering them (a range-partitioned global rank).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.functions.arrays import explode_rows
from stepcorpus.functions.ranking import with_global_rank
from stepcorpus.session import BROADCAST_MAX_ROWS, materialize


# ----------------------------------------------------------------- T1 / T2


def tokenize(text: Column) -> Column:
    """Text -> array<string> (regex tokenizer, specials whole)."""
    return T.tokenize(text)


def specials_table(spark: SparkSession) -> DataFrame:
    rows = [(tok, i) for i, tok in enumerate(S.SPECIAL_TOKENS)]
    return spark.createDataFrame(rows, "token string, token_id bigint")


def special_ids() -> dict[str, int]:
    """Fixed ids of the special tokens (their position in ``SPECIAL_TOKENS``)."""
    return {t: i for i, t in enumerate(S.SPECIAL_TOKENS)}


def build_vocab(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(token, token_id, n)``.  Special tokens take ids 0..k-1 in their
    fixed order; every other token follows by falling count, then by its
    UTF-8 bytes (Spark and DuckDB compare strings the same way).

    The corpus is read once: token counts (partial aggregation absorbs the
    Zipf-hot tokens) are checkpointed, the ranking runs on that small table,
    and the finished vocabulary is checkpointed so every encode/decode that
    uses it sees the same ids without recomputing it."""
    spark = df.sparkSession
    counts = materialize(explode_rows(df, tokens, value="token")
                         .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    k = len(S.SPECIAL_TOKENS)
    ranked = with_global_rank(counts.filter(~F.col("token").isin(*S.SPECIAL_TOKENS)),
                              [F.col("n").desc(), F.col("token").asc()], "rank")
    words = ranked.select("token", (F.col("rank") + F.lit(k - 1)).alias("token_id"), "n")
    specials = (specials_table(spark).join(counts, "token", "left")
                .select("token", "token_id", F.coalesce("n", F.lit(0)).alias("n")))
    return materialize(specials.unionByName(words))


HEAD_IDS = 65_536  # most frequent vocabulary rows, which every task holds
HEAD_CHARS = 64  # of a token in that head, which bounds its bytes


def _head(vocab: DataFrame, src: str, dst: str) -> tuple[pa.Table, DataFrame, bool]:
    """``(head, rest, whole)``: the first ``HEAD_IDS`` rows (ids are in order of
    frequency, so they hold the hot keys), the others, and whether there are none."""
    short = F.length("token") <= HEAD_CHARS if "token" in vocab.columns else F.lit(True)
    in_head = (F.col("token_id") < HEAD_IDS) & short & F.col(src).isNotNull() & F.col(dst).isNotNull()
    lookup = vocab.withColumn("_head", F.coalesce(in_head, F.lit(False)))
    head = lookup.filter("_head").select(src, dst).toArrow()  # bounded by the two constants
    n = vocab.count()
    return head, lookup.filter(~F.col("_head")).select(src, dst), n == len(head) and n <= BROADCAST_MAX_ROWS


def _flat(rows: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All elements of the lists, and where each list starts (and the end); a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return rows.flatten(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _resolvers(spark: SparkSession, head: pa.Table, src: str, dst: str, src_type: DataType, kind: DataType, key: str, hot: dict):
    """Three functions of columns: an array's elements as the head and ``hot`` have them (else null),
    its other elements with their positions, and the first array with the nulls replaced by found ones."""
    to = to_arrow_type(kind)
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    keys = pa.array([plain(x) for x in hot], to_arrow_type(src_type))
    others = head.filter(pc.invert(pc.is_in(head[src], keys))).combine_chunks()
    shared = spark.sparkContext.broadcast((
        pa.concat_arrays([keys, *others[src].cast(keys.type).chunks]),
        pa.concat_arrays([pa.array([plain(x) for x in hot.values()], to), *others[dst].cast(to).chunks])))

    @F.arrow_udf(ArrayType(kind))
    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, values = shared.value
        for rows in batches:
            flat, at = _flat(rows)
            yield pa.ListArray.from_arrays(at, values.take(pc.index_in(flat, keys)))

    far_type = StructType([StructField("pos", IntegerType()), StructField(src, src_type)])

    @F.arrow_udf(ArrayType(far_type))
    def far(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, _ = shared.value
        for rows in batches:
            flat, at = _flat(rows)
            open_ = np.flatnonzero(pc.is_null(pc.index_in(flat, keys)).to_numpy(zero_copy_only=False))
            row = np.searchsorted(at, open_, side="right") - 1
            cells = pa.StructArray.from_arrays([pa.array(open_ - at[row], pa.int32()), flat.take(pa.array(open_))], ["pos", src])
            yield pa.ListArray.from_arrays(np.searchsorted(open_, at).astype(np.int32), cells)

    @F.arrow_udf(ArrayType(kind))
    def filled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows, found in batches:
            flat, at = _flat(rows)
            cells, cell_at = _flat(found)
            nulls = np.concatenate([[0], np.cumsum(pc.is_null(flat).to_numpy(zero_copy_only=False))])
            if (np.diff(nulls[at]) != np.diff(cell_at)).any():
                raise ValueError(f"{key} is not unique")
            where = np.arange(len(flat))
            to_fill = cells.field("pos").to_numpy(zero_copy_only=False) + np.repeat(at[:-1], np.diff(cell_at))
            where[to_fill] = len(flat) + np.arange(len(cells))
            yield pa.ListArray.from_arrays(at, pa.concat_arrays([flat, cells.field(dst).cast(flat.type)]).take(pa.array(where)))

    return near, far, filled


def _check_unique(df: DataFrame, array: str, key: str, hot: dict) -> None:
    """Raises where a repeated or null key has elements to look up; only such keys' arrays are read."""
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_again"))
    if again.isEmpty():
        return
    asked = F.exists(array, lambda x: ~F.coalesce(x.isin(*[F.lit(h) for h in hot]) if hot else F.lit(False), F.lit(False)))
    if not df.join(again, df[key].eqNullSafe(F.col("_again")), "left_semi").filter(asked).isEmpty():
        raise ValueError(f"{key} is not unique")


def _look_up(df: DataFrame, array: str, src: str, dst: str, vocab: DataFrame, key: str, hot: dict) -> DataFrame:
    """``df`` with ``_got``: the looked-up elements of ``array`` in order.

    Elements in ``hot`` (the image pads, most positions of a sample) and in the
    vocabulary's head are resolved in the row; only the others become rows and
    meet the rest of the vocabulary in a join, whatever its size.
    ``key`` must be unique: a row that gets another one's positions is an error."""
    src_type, kind = vocab.schema[src].dataType, vocab.schema[dst].dataType
    _check_unique(df, array, key, hot)
    head, rest, whole = _head(vocab, src, dst)
    near, far, filled = _resolvers(df.sparkSession, head, src, dst, src_type, kind, key, hot)
    elements = F.col(array).cast(ArrayType(src_type))
    got = df.withColumn("_got", near(elements))
    if whole:
        return got
    others = explode_rows(df.select(key, far(elements).alias("_far")), "_far", [key], value="s").select(key, "s.*")
    found = others.join(rest, src, "left").groupBy(key).agg(F.collect_list(F.struct("pos", dst)).alias("_found"))
    none = F.array().cast(found.schema["_found"].dataType)
    return got.join(found, key, "left").withColumn("_got", filled("_got", F.coalesce("_found", none))).drop("_found")


def encode(df: DataFrame, tokens: str, vocab: DataFrame, key: str, out: str = "input_ids",
           hot: dict[str, int] | None = None) -> DataFrame:
    """Token strings -> ids, keeping order, for rows with a unique ``key``.
    ``hot`` tokens with known ids (default: the special tokens) and frequent ones
    are never exploded; the others meet the vocabulary in a join (``_look_up``)."""
    hot = special_ids() if hot is None else hot
    ids = _look_up(df, tokens, "token", "token_id", vocab, key, hot)
    return ids.withColumn(out, F.coalesce("_got", F.array().cast("array<bigint>"))).drop("_got")


def decode(df: DataFrame, ids: str, vocab: DataFrame, key: str, out: str = "text",
           hot: dict[int, str] | None = None) -> DataFrame:
    """Ids -> text by joining the vocabulary and concatenating in order (``key`` unique)."""
    hot = {v: k for k, v in special_ids().items()} if hot is None else hot
    toks = _look_up(df, ids, "token_id", "token", vocab, key, hot)
    return toks.withColumn(out, F.coalesce(F.array_join("_got", ""), F.lit(""))).drop("_got")


# ------------------------------------------------------------ T3, T4, T7, T8


def concat_qa(q: Column, a: Column) -> Column:
    """``q + a``."""
    return F.concat(q, a)


def prefix_mask_labels(q: Column, a: Column, pad: Column) -> Column:
    """T4: pad for every prompt position, then the answer."""
    return F.concat(F.array_repeat(pad, F.size(q)), a)


def clone_labels(ids: Column) -> Column:
    """Labels equal the input ids, prompt included."""
    return ids


def shift_pair(ids: Column, labels: Column) -> tuple[Column, Column]:
    """``(ids[:-1], labels[1:])``; lengths 0 and 1 give empty arrays."""
    n_ids = F.greatest(F.size(ids) - 1, F.lit(0))
    n_lab = F.greatest(F.size(labels) - 1, F.lit(0))
    return F.slice(ids, 1, n_ids), F.slice(labels, 2, n_lab)


# ----------------------------------------------------------------- T5 / T6


def assistant_spans(ids: Column, assistant: Column, end: Column) -> tuple[Column, Column]:
    """T5: half-open spans ``[a+1, e+1)`` from the first ``assistant`` token of
    each ``<|im_end|>``-delimited segment through that segment's end token.

    Returns ``(spans array<struct<start,end>>, unclosed boolean)``; an
    ``assistant`` token with no later end token makes the row unclosed (the
    scripts fall back to a default sample).

    Linear in the row length: the segment bounds are zipped before any lambda
    runs, so no lambda refers to a per-row array other than ``ids`` (Catalyst
    would otherwise inline and re-evaluate it once per element).
    """
    n = F.size(ids)
    ends = F.filter(T.index_range(n), lambda i: F.get(ids, i) == end)
    starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1))
    stops = F.concat(ends, F.array(n))
    closed = F.concat(F.array_repeat(F.lit(True), F.size(ends)), F.array(F.lit(False)))
    segs = F.arrays_zip(starts.alias("lo"), stops.alias("hi"), closed.alias("closed"))

    def first_assistant(z: Column) -> Column:
        p = F.array_position(F.slice(ids, z["lo"] + 1, F.greatest(z["hi"] - z["lo"], F.lit(0))), assistant)
        return F.struct(F.when(p > 0, z["lo"] + p - 1).otherwise(F.lit(-1)).alias("a"),
                        z["hi"].alias("hi"), z["closed"].alias("closed"))

    found = F.transform(segs, first_assistant)
    spans = F.transform(F.filter(found, lambda s: (s["a"] >= 0) & s["closed"]),
                        lambda s: F.struct((s["a"] + 1).alias("start"), (s["hi"] + 1).alias("end")))
    unclosed = F.element_at(found, -1)["a"] >= 0
    return spans, unclosed


def span_mask_labels(ids: Column, spans: Column, pad: Column) -> Column:
    """Pad everywhere, the input id inside any span.  Spans must be
    sorted and disjoint (T5's are); the labels are built piece by piece
    (pad gap, copied span) so the cost is linear in the row length."""
    n = F.size(ids)
    prev_end = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"].cast("int")))
    ext = F.concat(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"),
                                                           s["end"].cast("int").alias("end"))),
                   F.array(F.struct(n.alias("start"), n.alias("end"))))
    pieces = F.transform(F.arrays_zip(prev_end.alias("p"), ext.alias("s")), lambda z: F.concat(
        F.array_repeat(pad, F.greatest(z["s"]["start"] - z["p"], F.lit(0))),
        F.slice(ids, z["s"]["start"] + 1, F.greatest(z["s"]["end"] - z["s"]["start"], F.lit(0)))))
    return F.flatten(pieces)


# --------------------------------------------------------------------- T12


def attention_mask(ids: Column, pad: Column) -> Column:
    """1 where the id is not the pad id (computed after padding)."""
    return F.transform(ids, lambda t: (t != pad).cast("int"))
