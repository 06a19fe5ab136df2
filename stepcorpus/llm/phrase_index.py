"""Benchmark decontamination by a positional inverted index of the corpus.

The index is split by document: a row holds one document's postings, the
positions of every test term in it, grouped by term.  It is written once,
as Parquet.  Corpus frequencies summed over it order the terms by rarity.
A search starts at the postings of each phrase's rarest term, moves them
back by the term's offset, and keeps the starts at which the next rarer
term's list has the wanted position too, until the phrase is complete.

Test items come in blocks of ``BLOCK_WORDS`` words at most (one longer item
stands alone), each block with an index of its own terms, so neither a
task nor the driver holds more test text than that.

Null texts have no words.  Documents without hits keep their row.  Rows
that repeat a doc_id keep a row each.  Extra columns are ignored.  Items
with a null id or text have no phrases; equal item ids count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepcorpus.llm.arrowtext import as_bytes, spans_of
from stepcorpus.session import broadcast_if_small, materialize

WINDOW = 13
BLOCK_WORDS = 1_000_000
SLOP = 3  # words by which a proximity match may move a term against the rarest one
NEAR_TERMS = 5  # rarest terms of a phrase that a proximity match needs

#: A-Z to a-z, and every byte that no word holds to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(FOLD).split() if text else []


@dataclass
class Phrases:
    """A block of test phrases: terms by number, and of each phrase its terms' numbers and its items."""

    terms: dict[bytes, int]
    phrases: np.ndarray  # (phrases, longest) term numbers, -1 beyond the end
    length: np.ndarray
    items: list[list[str]]

    @staticmethod
    def of(items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> "Phrases":
        terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for key, words in items:
            ids = [terms.setdefault(w, len(terms)) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i:i + window]), set()).add(str(key))
        out = np.full((len(found), window), -1, np.int64)
        for row, phrase in zip(out, found):
            row[:len(phrase)] = phrase
        return Phrases(terms, out, (out >= 0).sum(1), [sorted(x) for x in found.values()])


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items and their words, in blocks of at most ``limit`` words."""
    block, size = [], 0
    for key, text in as_bytes(benchmark, F.col("item_id").cast("string").alias("item_id")).toLocalIterator():
        words = words_of(text)
        if key is None or not words:
            continue
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((key, words))
        size += len(words)
    if block:
        yield block


def store_postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(row_id, doc_id, n_words, terms, counts, positions): the written index of ``docs`` for these terms."""
    def task(batches):
        number = terms.get
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                n_words, parts = [], ([], [], [])
                for text in part.column(2).to_pylist():
                    ids = np.array([number(w, -1) for w in words_of(text)], np.int32)
                    n_words.append(len(ids))
                    at = np.flatnonzero(ids >= 0)
                    at = at[np.argsort(ids[at], kind="stable")]
                    used, counts = np.unique(ids[at], return_counts=True)
                    for out, x in zip(parts, (used, counts, at)):
                        out.append(x.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words, pa.int64()), *(pa.array(x, pa.binary()) for x in parts)],
                                                 ["row_id", "doc_id", "n_words", "terms", "counts", "positions"])

    return materialize(as_bytes(docs, "row_id", "doc_id").mapInArrow(task, _index_schema(docs)), "postings")


def _index_schema(docs: DataFrame) -> str:
    return f"row_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, terms binary, counts binary, positions binary"


def term_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each test term in the corpus: a sum of one row a task and term."""
    def task(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[np.frombuffer(t, "<i4")] += np.frombuffer(c, "<i4")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(task, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n  # as many rows as the block has terms at most
    return out


def _plan(p: Phrases, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each phrase the offsets of its terms, rarest first; and the phrases ordered by their rarest term."""
    cost = np.where(p.phrases >= 0, frequency[np.maximum(p.phrases, 0)], np.iinfo(np.int64).max)
    order = np.argsort(cost, axis=1, kind="stable")
    rarest = p.phrases[np.arange(len(p.phrases)), order[:, 0]] if len(p.phrases) else np.zeros(0, np.int64)
    return order, np.argsort(rarest, kind="stable")


def search(index: DataFrame, p: Phrases, frequency: np.ndarray, slop: int = SLOP, near_terms: int = NEAR_TERMS) -> DataFrame:
    """Per indexed document: (row_id, doc_id, n_words, exact, lengths, items, near, near_items).

    ``exact`` and ``near`` list (phrase, start) of the exact phrase matches
    and of the proximity matches: places of the rarest term around which the
    ``near_terms`` rarest terms stand within ``slop`` words of their offsets.
    ``near_items`` has the items of each of these.
    """
    order, by_rarest = _plan(p, frequency)
    rows = np.arange(len(p.phrases))
    rarest = p.phrases[rows, order[:, 0]][by_rarest] if len(rows) else np.zeros(0, np.int64)
    match = pa.list_(pa.struct([("phrase", pa.int32()), ("start", pa.int32())]))

    def starts_of(used, ends, positions):
        """Postings of each phrase's rarest term, as (phrase, position)."""
        first, last = np.searchsorted(rarest, used, "left"), np.searchsorted(rarest, used, "right")
        hit = np.flatnonzero(last > first)
        begin = ends - np.diff(ends, prepend=0)
        phrase = [np.tile(by_rarest[first[i]:last[i]], ends[i] - begin[i]) for i in hit]
        place = [np.repeat(positions[begin[i]:ends[i]], last[i] - first[i]) for i in hit]
        return (np.concatenate(phrase), np.concatenate(place)) if hit.size else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def document(n_words, terms, counts, positions):
        used, positions = np.frombuffer(terms, "<i4").astype(np.int64), np.frombuffer(positions, "<i4").astype(np.int64)
        ends = np.cumsum(np.frombuffer(counts, "<i4").astype(np.int64))
        phrase, place = starts_of(used, ends, positions)
        if not len(phrase):
            return [], []
        key = np.repeat(used, np.diff(ends, prepend=0)) * (n_words + 1) + positions  # sorted: all lists in one

        def has(wanted_term, wanted_at):
            want = wanted_term * (n_words + 1) + wanted_at
            i = np.minimum(np.searchsorted(key, want), len(key) - 1)
            return (wanted_at >= 0) & (wanted_at < n_words) & (key[i] == want)

        start = place - order[phrase, 0]
        ok = (start >= 0) & (start + p.length[phrase] <= n_words)
        exact_phrase, exact_start = phrase[ok], start[ok]
        for j in range(1, p.phrases.shape[1]):
            if not len(exact_phrase):
                break
            off = order[exact_phrase, j]
            term = p.phrases[exact_phrase, off]
            ok = (term < 0) | has(term, exact_start + off)
            exact_phrase, exact_start = exact_phrase[ok], exact_start[ok]

        for j in range(1, min(near_terms, p.phrases.shape[1])):
            if not len(phrase):
                break
            off = order[phrase, j]
            term = p.phrases[phrase, off]
            low = np.clip(start + off - slop, 0, n_words)
            i = np.minimum(np.searchsorted(key, term * (n_words + 1) + low), len(key) - 1)
            found = key[i] - term * (n_words + 1)
            ok = (term < 0) | ((found >= low) & (found <= np.minimum(start + off + slop, n_words - 1)))  # beyond the end lies the next term
            phrase, start = phrase[ok], start[ok]
        return list(zip(exact_phrase.tolist(), exact_start.tolist())), list(zip(phrase.tolist(), start.tolist()))

    def task(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                got = [document(*x) for x in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5)))]
                as_rows = [pa.array([[{"phrase": a, "start": s} for a, s in g[k]] for g in got], match) for k in (0, 1)]
                items = pa.array([sorted({x for a, _ in g[0] for x in p.items[a]}) for g in got], pa.list_(pa.string()))
                lengths = pa.array([[int(p.length[a]) for a, _ in g[0]] for g in got], pa.list_(pa.int32()))
                near_items = pa.array([[p.items[a] for a, _ in g[1]] for g in got], pa.list_(pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], as_rows[0], lengths, items, as_rows[1], near_items],
                                                 ["row_id", "doc_id", "n_words", "exact", "lengths", "items", "near", "near_items"])

    kind = index.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(task, f"row_id long, doc_id {kind}, n_words long, exact array<struct<phrase:int,start:int>>, lengths array<int>, "
                                  "items array<string>, near array<struct<phrase:int,start:int>>, near_items array<array<string>>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, slop: int = SLOP) -> DataFrame:
    """Per document: doc_id, n_words, spans (hit word ranges), items, n_near (proximity matches), near (their items and starts).

    A proximity match of a phrase that several items have counts once in
    ``n_near`` and stands in ``near`` for each of them.  Its start is where
    the phrase would begin by its rarest term, so it may lie before the text.

    With more than one block, each block's matches are joined by the row's
    number in the written list of documents.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    todo = blocks(benchmark, block_words)
    first = next(todo, [])  # an empty benchmark is one block without phrases
    second = next(todo, None)
    if second is not None:
        keyed = materialize(keyed, "numbered")
    found = []
    while first is not None:
        p = Phrases.of(first, window)
        index = store_postings(keyed, p.terms)
        matches = search(index, p, term_frequencies(index, len(p.terms)), slop)
        found.append(matches.select("row_id", "doc_id", "n_words", _spans(F.col("exact"), F.col("lengths")).alias("spans"), "items",
                                    F.size("near").cast("long").alias("n_near"), _near(F.col("near"), F.col("near_items")).alias("near")))
        first, second = second, next(todo, None)
    matches = reduce(DataFrame.unionByName, found)
    if len(found) > 1:
        # a document has as many rows as there are blocks
        matches = (matches.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                              F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"),
                                              F.flatten(F.collect_list("near")).alias("near")))
    return matches.drop("row_id")


def _spans(exact, lengths):
    """Half-open word ranges of the exact matches."""
    return F.zip_with(exact, lengths, lambda m, n: F.struct(m["start"].alias("begin"), (m["start"] + n).alias("end")))


def _near(near, items):
    """(item, start) of the proximity matches."""
    return F.flatten(F.zip_with(near, items, lambda m, xs: F.transform(xs, lambda x: F.struct(x.alias("item"), m["start"].alias("start")))))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items of ``contamination``."""
    # hit words: sorted by begin, each span adds what lies beyond the furthest end so far
    ends = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
                       lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
                       lambda a: a["n"].cast("long"))
    out = found.withColumn("n_hit", ends)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text is contaminated.  A text is judged once, under its digest, so rows that
    share a doc_id are judged apart and rows of one text alike."""
    digest_of = F.unhex(F.md5("text"))
    texts = docs.select(digest_of.alias("doc_id"), "text")
    bad = digest(contamination(texts, benchmark, **options)).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    bad, _ = broadcast_if_small(materialize(bad, "contaminated"))  # beyond the checked size a shuffle join
    return docs.join(bad, digest_of == F.col("_bad"), "left_anti")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (select doc_id, {_WORDS_SQL} ws from documents),
b as (select item_id::varchar item_id, {_WORDS_SQL} ws from benchmark where item_id is not null),
iw as (select distinct item_id, least({WINDOW}, len(ws)) l, ws[i:i + least({WINDOW}, len(ws)) - 1] win from b, unnest(generate_series(1, greatest(1, len(ws) - {WINDOW - 1}))) u(i) where len(ws) > 0),
dw as (select doc_id, i, l, ws[i:i + l - 1] win from (select distinct l from iw) x, d, unnest(generate_series(1, len(ws) - l + 1)) u(i)),
m as (select doc_id, i, l, item_id from dw join iw using (l, win)),
h as (select doc_id, count(distinct i + k) n_hit from m, unnest(generate_series(0, l - 1)) v(k) group by doc_id),
c as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from m) group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from d left join h using (doc_id) left join c using (doc_id)
"""


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract read literally, for tests: no index, one scan of each document."""
    import re
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    wanted: dict[tuple, set] = {}
    for key, text in items:
        w = find(text)
        for i in range(max(1, len(w) - window + 1) if w and key is not None else 0):
            wanted.setdefault(tuple(w[i:i + window]), set()).add(str(key))
    out = []
    for key, text in docs:
        w = find(text)
        hit, got = np.zeros(len(w), bool), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i:i + n])) in wanted:
                    hit[i:i + n] = True
                    got |= wanted[x]
        n_hit = int(hit.sum())
        assert n_hit == sum(b - a for a, b in zip(*spans_of(hit)))
        out.append((key, len(w), n_hit, len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(w)))
    return out
