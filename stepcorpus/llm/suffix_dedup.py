"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

Suffixes are sorted at anchors only: in each window of ``length`` bytes the
place of the smallest hash of ``KMER`` bytes (the leftmost of equals).  Equal
windows have equal anchors, so each repeated window is seen at an anchor
inside it, as a left part and a right part of the anchor's context, the
bytes less than ``length`` before it and up to ``length`` from it on.

1. Anchors of all texts, with hashes of their KMER bytes and their context.
2. An equal context elsewhere: all of the context is repeated.  Nothing is
   left to compare where the anchor's bytes occur nowhere else.
3. One occurrence of each other context is exchanged: tasks send sorted,
   front-coded runs of the suffixes from the anchors on, by anchor bytes.
4. A loser tree merges the runs.  It keeps the common prefix of each
   waiting suffix with the last one sent out, so a comparison starts where
   the known prefixes end, and the prefixes of neighbours come for free.
   From them and the left parts follow each context's longest left and
   right extents within a repeated window.
5. Anchors whose bytes have more than ``HOT`` contexts don't meet in one
   task: their windows' hashes are counted in a grouping of their own.
6. The extents, joined to all anchors, give the ranges to remove.

Null texts are empty.  Rows that repeat are occurrences like any other.  A
null doc_id stays null.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepcorpus.llm.arrowtext import mix64, powers, prefix_hash, slices, stretch_hash
from stepcorpus.session import bound_batches, materialize

LENGTH = 400
KMER = 32
HOT = 100_000  # contexts of equal anchor bytes that one task compares, about 100 MB
PAIRWISE = 64  # contexts up to which a group is compared pair by pair
RUN_CONTEXTS = 40_000  # of a merge task, about
RUN_BYTES = 16 << 20  # of suffixes and left parts that a task sorts at once, about
PIECE = 1 << 18  # bytes handled at once; positions in a piece fit in 24 bits
NULL_ID = -(1 << 63)


# ---- anchors

def _anchors_of_piece(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Anchors of the windows that don't cross an end."""
    w = length - KMER + 1
    n = len(data) - KMER + 1
    if len(data) < length:
        return np.zeros(0, np.int64)
    prefix = prefix_hash(data)
    v = mix64((prefix[KMER:] - prefix[:-KMER]) * powers(n)[1])
    v = (v & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    rows = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = v
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - w + 1
    low = np.minimum(behind[:starts], ahead[w - 1:w - 1 + starts])
    keep = np.ones(starts, bool)
    for e in ends[:-1]:
        keep[max(0, e - length + 1):e] = False
    at = (low[keep] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def anchors_of(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of the anchors in the texts of a slice; a text longer than a piece is cut into overlapping ones."""
    found = [_anchors_of_piece(data[lo:lo + 4 * PIECE + length - 1], at[1:] - lo if len(data) <= 4 * PIECE else np.array([len(data)]), length) + lo
             for lo in range(0, max(1, len(data)), 4 * PIECE)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, key, pos, kmer, ctx, before, after): anchors, hashes, and how far their contexts reach."""
    def task(batches):
        for b in batches:
            ids, keys = (b.column(i).to_numpy() for i in (0, 1))
            for lo, _, data, at in slices(b, "text", PIECE):
                pos = anchors_of(data, at, length)
                doc = np.searchsorted(at, pos, side="right") - 1
                start, end = np.maximum(at[doc], pos - length + 1), np.minimum(at[doc + 1], pos + length)
                prefix = prefix_hash(data)
                context = mix64(stretch_hash(prefix, start, end) + mix64(((pos - start).astype(np.uint64) << np.uint64(32)) + (end - pos).astype(np.uint64)))
                kmer = stretch_hash(prefix, pos, pos + KMER)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + doc]), pa.array(keys[lo + doc]), pa.array(pos - at[doc], pa.int64()), pa.array(kmer.view(np.int64)), pa.array(context.view(np.int64)),
                                                  pa.array(pos - start, pa.int32()), pa.array(end - pos, pa.int32())], ["id", "key", "pos", "kmer", "ctx", "before", "after"])

    return materialize(docs.select("id", "key", "text").mapInArrow(task, "id long, key long, pos long, kmer long, ctx long, before int, after int"), "anchors")


# ---- sorted runs: (suffix, reversed left part, context, anchor bytes), front-coded by suffix

Entry = tuple[bytes, bytes, int, int]


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, ``start`` bytes of which are known."""
    end = min(len(a), len(b))
    while start < end:
        stop = min(start + 64, end)
        x, y = a[start:stop], b[start:stop]
        if x != y:  # the first set bit of the difference
            return stop - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8
        start = stop
    return end


def write_run(entries: list[Entry]) -> bytes:
    """A sorted run: each suffix as the length of its common prefix with the one before, and the rest."""
    shared, rest, last = [], [], b""
    for suffix, *_ in entries:
        n = common(last, suffix)
        shared.append(n)
        rest.append(suffix[n:])
        last = suffix
    numbers = np.array([shared, [len(x) for x in rest], [len(e[1]) for e in entries]], "<u4")
    raw = b"".join((np.array([len(entries)], "<u4").tobytes(), numbers.tobytes(), np.array([[e[2] for e in entries], [e[3] for e in entries]], "<i8").tobytes(), *rest, *(e[1] for e in entries)))
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def read_run(raw: bytes) -> Iterator[tuple[int, Entry]]:
    """(common prefix with the entry before, entry) in order."""
    raw = pa.Codec("zstd").decompress(raw[8:], struct.unpack_from("<Q", raw)[0], asbytes=True)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    shared, size, left = (x.tolist() for x in np.frombuffer(raw, "<u4", 3 * n, 4).reshape(3, n))
    ctx, kmer = (x.tolist() for x in np.frombuffer(raw, "<i8", 2 * n, 4 + 12 * n).reshape(2, n))
    at = 4 + 28 * n
    at_left, last = at + sum(size), b""
    for i in range(n):
        last = last[:shared[i]] + raw[at:at + size[i]]
        yield shared[i], (last, raw[at_left:at_left + left[i]], ctx[i], kmer[i])
        at += size[i]
        at_left += left[i]


def merge(runs: list[bytes]) -> Iterator[tuple[int, Entry]]:
    """One sorted run of all: (common prefix with the entry before, entry).

    A tournament of losers.  ``lcp[i]`` is the common prefix of run i's first
    entry with the entry it last lost to, or at the leaf with the one sent
    out before; of two entries that met the same winner the one with the
    longer common prefix is smaller, and only equal lengths need bytes, from
    that length on.
    """
    streams = [read_run(r) for r in runs]
    k = len(streams)
    heads: list[Entry | None] = [None] * k
    lcp = [0] * k
    for i, s in enumerate(streams):
        _, heads[i] = next(s, (0, None))

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of runs i and j; the loser's lcp becomes that with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        n = common(a[0], b[0], lcp[i])
        first, second = (i, j) if a[0][n:n + 1] <= b[0][n:n + 1] else (j, i)
        lcp[second] = n
        return first, second

    size = 1
    while size < k:
        size *= 2
    losers = [-1] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size if node - size < k else -1
        i, j = build(2 * node), build(2 * node + 1)
        if i < 0 or j < 0:
            losers[node] = -1
            return max(i, j)
        win, lose = play(i, j)
        losers[node] = lose
        return win

    win = build(1) if k else -1
    while win >= 0 and heads[win] is not None:
        yield lcp[win], heads[win]
        shared, head = next(streams[win], (0, None))
        heads[win], lcp[win] = head, shared  # with the entry just sent out
        node = (win + size) // 2
        while node:
            if losers[node] >= 0:
                win, losers[node] = play(win, losers[node])
            node //= 2


# ---- extents

def _pairwise(group: list[tuple[int, Entry]], length: int) -> tuple[list[int], list[int]]:
    left, right = [-1] * len(group), [-1] * len(group)
    for i in range(len(group)):
        r = length
        for j in range(i + 1, len(group)):
            r = min(r, group[j][0])
            if r < KMER:
                break
            n = common(group[i][1][1], group[j][1][1])
            if n + r >= length:
                for k in (i, j):
                    left[k], right[k] = max(left[k], n), max(right[k], r)
    return left, right


def _by_offset(group: list[tuple[int, Entry]], length: int) -> tuple[list[int], list[int]]:
    """The same without pairs: for each place of the anchor in the window, contexts that agree on both sides share a class."""
    m = len(group)
    r = np.array([x[0] for x in group])
    order = sorted(range(m), key=lambda i: group[i][1][1])
    ell = np.array([0, *(common(group[a][1][1], group[b][1][1]) for a, b in zip(order, order[1:]))])
    left, right = np.full(m, -1), np.full(m, -1)
    side = np.empty(m, np.int64)
    # a pair fits from the place that its right part allows to the one its left part allows: only those can be extremes
    for o in sorted({n for n in {*ell.tolist(), *(length - r).tolist()} if 0 <= n < length}):
        side[order] = np.cumsum(ell < o)
        key = np.cumsum(r < length - o) * (m + 1) + side
        by_key = np.argsort(key, kind="stable")
        equal = key[by_key[1:]] == key[by_key[:-1]]
        again = np.union1d(by_key[1:][equal], by_key[:-1][equal])
        left[again] = o
        right[again] = np.maximum(right[again], length - o)
    return left.tolist(), right.tolist()


def extents(merged: Iterator[tuple[int, Entry]], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(context, bytes before its anchor, bytes from it on) that lie in repeated windows, of contexts that have any."""
    def close(group):
        left, right = (_pairwise if len(group) <= PAIRWISE else _by_offset)(group, length)
        for (_, e), n, r in zip(group, left, right):
            if r >= 0:
                yield e[2], n, r

    group: list[tuple[int, Entry]] = []
    for shared, e in merged:
        if group and shared < KMER:
            yield from close(group)
            group = []
        group.append((shared, e))
    if group:
        yield from close(group)


# ---- Spark

def _runs(docs: DataFrame, wanted: DataFrame, parts: int, length: int) -> DataFrame:
    """(part, run): sorted front-coded runs of the wanted contexts, a run a part and ``RUN_BYTES``; part -1 holds the hot ones."""
    def written(by_part: dict[int, list[Entry]]) -> pa.RecordBatch:
        rows = [(part, write_run(sorted(by_part.pop(part)))) for part in sorted(by_part)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "run"])

    def task(batches):
        by_part: dict[int, list[Entry]] = {}
        held = 0
        for b in batches:
            for text, places in zip(b.column(0), b.column(1)):
                raw = text.as_py()
                for p in places.as_py():
                    at = p["pos"]
                    part = -1 if p["hot"] else p["kmer"] % parts
                    entry = (raw[at:at + length], raw[max(0, at - length + 1):at][::-1], p["ctx"], p["kmer"])
                    by_part.setdefault(part, []).append(entry)
                    held += len(entry[0]) + len(entry[1])
                    if held >= RUN_BYTES:
                        yield written(by_part)
                        held = 0
        if by_part:
            yield written(by_part)

    of_doc = wanted.groupBy("id", "key").agg(F.collect_list(F.struct("pos", "kmer", "ctx", "hot")).alias("places"))  # a document's own anchors
    return materialize(docs.join(of_doc.hint("shuffle_hash"), ["id", "key"]).select("text", "places").mapInArrow(task, "part int, run binary"), "runs")


def _merged_extents(runs: DataFrame, parts: int, length: int) -> DataFrame:
    def task(batches):
        for part, group in _groups(batches):
            got = list(extents(merge(group), length))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64() if not i else pa.int32()) for i in range(3)], ["ctx", "l", "r"])

    return runs.filter("part >= 0").repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(task, "ctx long, l int, r int")


def _groups(batches) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of one part after the other, from rows sorted by part."""
    last, group = None, []
    for b in batches:
        for part, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if part != last and group:
                yield last, group
                group = []
            last = part
            group.append(run)
    if group:
        yield last, group


def _hot_extents(runs: DataFrame, length: int) -> DataFrame:
    """Extents of contexts of hot anchors, by counting their windows' hashes."""
    def task(batches):
        for b in batches:
            for run in b.column(0).to_pylist():
                for _, (suffix, before, ctx, _) in read_run(run):
                    data = np.frombuffer(before[::-1] + suffix, np.uint8)
                    n = len(data) - length + 1
                    if n <= 0:
                        continue
                    prefix = prefix_hash(data)
                    start = np.arange(n)
                    back = len(before) - start  # bytes of the window before the anchor
                    h = mix64(stretch_hash(prefix, start, start + length) + back.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array([ctx] * n, pa.int64()), pa.array(back, pa.int32()), pa.array(h.view(np.int64))], ["ctx", "back", "window"])

    windows = materialize(runs.filter("part = -1").select("run").mapInArrow(task, "ctx long, back int, window long"), "hot-windows")
    again = windows.groupBy("window").count().filter("count > 1").select("window")
    return windows.join(again, "window", "left_semi").groupBy("ctx").agg(F.max("back").alias("l"), (F.lit(length) - F.min("back")).cast("int").alias("r"))


def removal_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, key, ranges): of each document with repeated strings, the byte ranges to remove (they may overlap)."""
    found = anchors(docs, length)
    contexts = materialize(found.groupBy("kmer", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "pos")).alias("ref"), F.first("before").alias("before"), F.first("after").alias("after")), "contexts")
    # a table of its own, so that the join can split an anchor that thousands of contexts share
    several = materialize(contexts.groupBy("kmer").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "several")
    wanted = materialize(contexts.join(several, "kmer").select("ref.*", "kmer", "ctx", (F.col("m") > HOT).alias("hot")), "wanted")
    n_wanted, any_hot = wanted.agg(F.count(F.lit(1)), F.max("hot")).first()
    reach = contexts.filter("n > 1").select("ctx", F.col("before").alias("l"), F.col("after").alias("r"))
    if n_wanted:
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_wanted // RUN_CONTEXTS)
        runs = _runs(docs, wanted, parts, length)
        reach = reach.union(_merged_extents(runs, parts, length))
        if any_hot:
            reach = reach.union(_hot_extents(runs, length))
    # a table of its own, so that the join can split a context that thousands of copies share
    reach = materialize(reach.groupBy("ctx").agg(F.max("l").alias("l"), F.max("r").alias("r")), "extents")
    spans = found.join(reach, "ctx").select("id", "key", F.struct((F.col("pos") - F.col("l")).alias("begin"), (F.col("pos") + F.col("r")).alias("end")).alias("span"))
    return spans.groupBy("id", "key").agg(F.array_sort(F.collect_set("span")).alias("ranges"))  # a document's own anchors


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and on request the kept bytes, of every document."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    ranges = materialize(removal_ranges(keyed.select("id", "key", "text"), length), "ranges")

    def task(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = []
                for text, spans in zip(part.column(1), part.column(2).to_pylist()):
                    raw = text.as_py()
                    kept, upto, removed, n = [], 0, 0, 0
                    end = -1  # of the run being removed
                    for s in spans or []:
                        if s["begin"] > end:
                            n += 1
                            kept.append(raw[upto:s["begin"]])
                        removed += max(0, s["end"] - max(s["begin"], end))
                        end = max(end, s["end"])
                        upto = end
                    kept.append(raw[upto:])
                    left = b"".join(kept)
                    out.append((len(raw), removed, n, hashlib.sha256(left).hexdigest(), left))
                    assert len(left) + removed == len(raw)
                cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)] + [pa.array([r[3] for r in out], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, *([pa.array([r[4] for r in out], pa.binary())] if texts else [])],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return keyed.join(ranges.hint("shuffle_hash"), ["id", "key"], "left").select("doc_id", "text", "ranges").mapInArrow(task, schema)


def brute_force(rows: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The contract read literally, for tests: every window counted."""
    from collections import Counter
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((key, len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out
