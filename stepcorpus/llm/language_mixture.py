"""Language of a document by a mixture over the languages it may hold.

Training sums hashed n-gram counts by language over all training rows.  For
a document, each word has a likelihood in every language (the product of its
n-grams' probabilities); expectation-maximisation estimates the languages'
proportions; the language set is the one of highest likelihood less a
penalty for each language after the first, among the sets of the largest
proportions, of any size.  The prediction is the largest proportion in that
set.  The set's languages are returned with their proportions in it.

Null texts and texts without a letter get ``und`` and score 0, as do all
texts where nothing could be learned.  Rows with a null doc_id or lang
don't train.  Repeated rows train and are predicted one by one.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepcorpus.llm.arrowtext import slices

FOLDS, FOLD = 3, 1  # crc32(doc_id) mod FOLDS = FOLD is held out
GRAM = 4  # bytes
BUCKETS = 1 << 15
SMOOTHING = 0.5
STEPS = 8
MIN_SHARE = 0.03  # of a language in the mixture, to be in the set
PENALTY = 1.0  # times log(words), for each language after the first
MIN_SCORE = 0.2  # of an accepted text's language: below it no language stands out
UNKNOWN = "und"

#: A-Z to a-z, other ASCII but letters to a space; bytes of longer characters stay.
FOLD_TABLE = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
LETTER = re.compile(r"[^\W\d_]")


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the n-gram at each byte, whether it counts): spaces follow a text's end, those of spaces only don't count."""
    n = len(data)
    low = np.concatenate([FOLD_TABLE[data], np.full(GRAM, 32, np.uint8)])
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | low[k:k + n]
    for left in range(1, GRAM):  # bytes left in the text
        i = at[1:] - left
        i = i[i >= at[:-1]]
        beyond = np.uint32((1 << 8 * (GRAM - left)) - 1)
        code[i] = (code[i] & ~beyond) | (np.uint32(0x20202020) & beyond)
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), code != 0x20202020


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and bucket) from the training rows; a table of fixed width."""
    def task(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for lo, hi, data, at in slices(b, "text"):
                bucket, used = grams(data, at)
                bucket = np.where(used, bucket, BUCKETS)
                for i in range(lo, hi):
                    got = np.bincount(bucket[at[i - lo]:at[i - lo + 1]], minlength=BUCKETS + 1)
                    if langs[i] in counts:
                        counts[langs[i]] += got
                    else:
                        counts[langs[i]] = got
        for lang, c in counts.items():
            used = np.flatnonzero(c[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(c[used], pa.int64())], ["lang", "bucket", "n"])

    train = docs.filter(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != FOLD))
    rows = (train.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(task, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).collect())
    langs = sorted(r.lang for r in rows)
    table = np.zeros((len(langs), BUCKETS))
    for r in rows:  # at most BUCKETS pairs a language
        pairs = np.array([(x.bucket, x.n) for x in r.c], np.int64)
        table[langs.index(r.lang), pairs[:, 0]] = pairs[:, 1]
    table = (table + SMOOTHING) / (table.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    return langs, np.log(table).astype(np.float32)


def word_likelihoods(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word by language likelihoods, scaled to a best of 1; first word of each text and the end)."""
    low = FOLD_TABLE[data] != 32
    begin = low.copy()
    if len(data):
        begin[1:] &= ~low[:-1]
        firsts = at[:-1][at[:-1] < at[1:]]
        begin[firsts] = low[firsts]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros((0, len(table))), first
    bucket, used = grams(data, at)
    out = np.zeros((len(starts), len(table)))
    if len(bucket):
        edges = np.minimum(np.concatenate([starts, [len(data)]]), len(bucket))
        for k, row in enumerate(table):
            total = np.concatenate([[0.0], np.cumsum(np.where(used, row[bucket], 0), dtype=np.float64)])
            out[:, k] = total[edges[1:]] - total[edges[:-1]]
    out -= out.max(1, keepdims=True)
    return np.exp(np.maximum(out, -40.0)), first


def proportions(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation by text: (proportions of the allowed languages, log likelihood)."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    some = np.flatnonzero(n)
    at = first[:-1][some]
    mix = like * share[doc]
    total = mix.sum(1)
    for _ in range(steps):
        share = np.zeros_like(share)
        share[some] = np.add.reduceat(mix / total[:, None], at, axis=0) / n[some, None]
        mix = like * share[doc]
        total = mix.sum(1)
    fit = np.zeros(len(n))
    if len(some):
        fit[some] = np.add.reduceat(np.log(np.maximum(total, 1e-300)), at)
    return share, fit


def choose(like: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: (best language, its proportion among all languages, size of the chosen set, proportions in the set, -1 outside it)."""
    n_docs, n_langs = len(first) - 1, like.shape[1]
    share, _ = proportions(like, first, np.ones((n_docs, n_langs)))
    order = np.argsort(-share, axis=1, kind="stable")
    best = order[:, 0] if n_langs else np.zeros(n_docs, np.int64)
    size = np.ones(n_docs, np.int64)
    inside = np.full((n_docs, n_langs), -1.0)
    if n_langs:
        inside[np.arange(n_docs), best] = 1.0
    enough = (np.take_along_axis(share, order, axis=1) >= MIN_SHARE).sum(1)  # languages that may be in the set
    top = np.full(n_docs, -np.inf)
    for k in range(1, int(enough.max(initial=0)) + 1):
        mixed = np.flatnonzero(enough >= max(k, 2))
        if not len(mixed):
            break
        n = np.diff(first)[mixed]
        rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in mixed])
        allowed = np.zeros((len(mixed), n_langs))
        np.put_along_axis(allowed, order[mixed, :k], 1.0, axis=1)
        held, fit = proportions(like[rows], np.concatenate([[0], np.cumsum(n)]), allowed)
        value = fit - PENALTY * (k - 1) * np.log(n + 1.0)
        better = value > top[mixed]
        to = mixed[better]
        top[to], size[to], best[to] = value[better], k, held[better].argmax(1)
        inside[to] = np.where(allowed[better] > 0, held[better], -1.0)
    return best, share[np.arange(n_docs), best] if n_langs else np.zeros(n_docs), size, inside


def judge(batch: pa.RecordBatch, langs: list[str], table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, languages, scores, set sizes, proportions in the sets) of runs of a batch's texts."""
    names = np.array([*langs, UNKNOWN], dtype=object)
    for lo, hi, data, at in slices(batch, "text"):
        known = np.array([LETTER.search(data[at[i]:at[i + 1]].tobytes().decode()) is not None for i in range(hi - lo)]) & bool(langs)
        best, share, size, inside = choose(*word_likelihoods(data, at, table)) if langs else (*(np.zeros(hi - lo, np.int64) for _ in range(3)), np.zeros((hi - lo, 0)))
        yield lo, hi, names[np.where(known, best, -1)], np.clip(np.where(known, share, 0.0), 0, 1), np.where(known, size, 0), inside


def _sets(langs: list[str], size: np.ndarray, inside: np.ndarray) -> pa.ListArray:
    """The languages of each text's set with their proportions, largest first."""
    order = np.argsort(-inside, axis=1, kind="stable")
    used = np.arange(len(langs)) < size[:, None]
    pairs = pa.StructArray.from_arrays([pa.array(np.array(langs, dtype=object)[order[used]], pa.string()), pa.array(np.clip(np.take_along_axis(inside, order, axis=1)[used], 0, 1), pa.float64())], ["lang", "share"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pairs)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_langs, languages (the set, with proportions) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(table)  # languages times BUCKETS numbers

    def task(batches):
        for b in batches:
            for lo, hi, lang, score, size, inside in judge(b, langs, model.value):
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(2)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int32()), _sets(langs, size, inside)],
                                                 ["doc_id", "held_out", "lang_pred", "score", "n_langs", "languages"])

    rows = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(task, f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_langs int, languages array<struct<lang:string,share:double>>")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, *learn(docs))


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` with a known language that holds ``min_score`` of the text at least."""
    langs, table = learn(docs)
    model = docs.sparkSession.sparkContext.broadcast(table)

    def task(batches):
        for b in batches:
            ok = [(lang != UNKNOWN) & (score >= min_score) for _, _, lang, score, _, _ in judge(b, langs, model.value)]
            if ok:
                yield b.filter(pa.array(np.concatenate(ok)))

    return docs.mapInArrow(task, docs.schema)
