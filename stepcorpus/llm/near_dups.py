"""Near-duplicate groups by a chosen-path similarity join of shingle sets.

A document's set is hashed to ``COORDINATES`` minwise values.  In each of
``TREES`` independent trees, a set is placed in a node for each of
``BRANCHES`` chosen coordinates, by its value there.  A node of at most
``SMALL`` sets compares all its members inside one task, first by sketches,
then by full sets, and gives the links that join different components, never
more than it has members.  A larger node compares every member with a few
representatives, and if members of different components remain, branches
again by coordinates chosen by the node.  Nodes that are still large at
``DEPTH`` are compared in blocks, so no pair is left out by size.  A pair of
similarity s misses a tree at one level with probability (1 - s) ** BRANCHES,
so four trees of two branches meet 99.9997 % of pairs of similarity 0.8 in a
first node.  A pair that meets in several first nodes is compared in one.

Equal sets are one class from the start: copies are never paired.  A pair
that agrees in ``AGREE`` coordinates is confirmed on the full sets, built
again from the whole texts of the documents concerned.  Members of the same
component are not compared.

Null texts and texts without words have an empty set and no links.  Rows
that share a doc_id are one document.  A row with a null doc_id is linked
with nothing and kept.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepcorpus.llm.arrowtext import as_bytes, mix64, slices, word_hashes, words
from stepcorpus.llm.components import components
from stepcorpus.session import broadcast_if_small, materialize

WORDS = 5  # of a shingle
PERCENT = 80
COORDINATES = 64
TREES, BRANCHES, DEPTH = 4, 2, 5
SMALL = 4096  # members that one task compares
BLOCK = 512  # members in a block of a node that stays large
STARS = 3  # representatives of a large node
COMPARED = 1 << 18  # hashes of one set's partners compared at once
PIECE = 1 << 18  # bytes of text hashed at once, each of which takes about a hundred meanwhile
ROWS = 256  # of a batch turned into Python objects at once
AGREE = 34  # of the coordinates; below it a pair of similarity 0.8 falls with probability 1e-6

_FACTORS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the texts' shingles in order, first shingle of each text and the end)."""
    starts, ends, first = words(data, at)
    w = word_hashes(data, starts, ends)
    n = np.diff(first)
    weight = mix64(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)
    padded = np.concatenate([w, np.zeros(size, np.uint64)])
    total = np.zeros(len(w), np.uint64)
    left = np.repeat(first[1:], n) - np.arange(len(w))  # words from here to the text's end
    for k in range(size):
        total += np.where(left > k, padded[k:k + len(w)] * weight[k], np.uint64(0))
    total += np.minimum(left, size).astype(np.uint64)
    keep = (left >= size) | (np.arange(len(w)) == np.repeat(first[:-1], n))
    keep &= (left >= size) | (np.repeat(n, n) < size)
    count = np.concatenate([[0], np.cumsum(keep)])
    return mix64(total[keep]), count[first]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch): set size, digest of the whole set, minwise values."""
    def task(batches):
        for b in batches:
            for lo, hi, data, at in slices(b, limit=PIECE):
                h, first = shingle_hashes(data, at, size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                low = np.zeros((hi - lo, COORDINATES), np.uint32)
                if len(some):
                    for k, factor in enumerate(_FACTORS):
                        low[some, k] = np.minimum.reduceat(((h * factor) >> np.uint64(32)).astype(np.uint32), first[:-1][some])
                sets = [np.unique(h[first[i]:first[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())],
                                                 ["doc_id", "n_shingles", "digest", "sketch"])

    return materialize(as_bytes(docs, "doc_id").mapInArrow(task, "doc_id long, n_shingles long, digest binary, sketch binary"), "sketches")


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, set) of the documents in ``ids``: sorted distinct hashes of the whole text."""
    def task(batches):
        for b in batches:
            for lo, hi, data, at in slices(b, limit=PIECE):
                h, first = shingle_hashes(data, at, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([np.unique(h[first[i]:first[i + 1]]).tobytes() for i in range(hi - lo)], pa.binary())], ["doc_id", "set"])

    wanted, _ = broadcast_if_small(materialize(ids, "wanted"))  # beyond the checked size a shuffle join
    return materialize(as_bytes(docs.join(wanted, "doc_id", "left_semi"), "doc_id").mapInArrow(task, "doc_id long, set binary"), "shingle-sets")


def _place(key: np.ndarray, doc: np.ndarray, sketch: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (node, document): the node chooses coordinates that no level above used, their values the child."""
    first = TREES * BRANCHES
    pool = (COORDINATES - first) // max(1, DEPTH - 1)
    out = []
    for k in range(BRANCHES):
        at = first + (level - 1) * pool + ((mix64(key) + np.uint64(k)) % np.uint64(pool)).astype(np.int64)
        value = sketch[np.arange(len(doc)), at].astype(np.uint64)
        out.append(mix64(key ^ mix64(value + (at.astype(np.uint64) << np.uint64(32)) + np.uint64(1 << 40))))
    return np.concatenate(out), np.tile(doc, BRANCHES)


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """(node, doc, tree) of the next level from (node, doc, sketch); level 0 starts all trees."""
    def task(batches):
        for b in batches:
            doc, sketch = b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            if not level:  # coordinates 0 and 1 for the first tree, 2 and 3 for the second, and so on
                n = TREES * BRANCHES
                key = mix64(sketch[:, :n].astype(np.uint64) + (np.arange(n, dtype=np.uint64) << np.uint64(32))).T.ravel()
                root = np.repeat(np.arange(n), len(doc))
                doc = np.tile(doc, n)
            else:
                key, doc = _place(b.column(0).to_numpy().view(np.uint64), doc, sketch, level)
                root = np.zeros(len(doc), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(root, pa.int32())], ["node", "doc", "root"])

    return rows.mapInArrow(task, "node long, doc long, root int")


class _Node:
    """Members of a node in one task."""

    def __init__(self, rows: list[tuple]):
        self.doc, self.comp, n, root, earlier = (np.array(c, np.int64) for c in list(zip(*rows))[:5])
        self.n, self.root, self.earlier = n, int(root[0]), earlier
        self.sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).reshape(-1, COORDINATES)
        self.sets = [np.frombuffer(r[6], np.uint64) for r in rows] if len(rows[0]) > 6 else []

    def candidates(self, i: int, comp: np.ndarray, percent: int) -> np.ndarray:
        """Later members that may be alike member i, of other components, that no earlier first node compares."""
        js = np.flatnonzero((comp[i + 1:] != comp[i]) & (100 * np.minimum(self.n[i], self.n[i + 1:]) >= percent * np.maximum(self.n[i], self.n[i + 1:]))) + i + 1
        if not len(js):
            return js
        same = self.sketch[js] == self.sketch[i]
        first = TREES * BRANCHES
        met = (same[:, :first] @ (1 << np.arange(first))) & self.earlier[i] & ((1 << self.root) - 1)
        return js[(same.sum(1) >= AGREE) & (met == 0)]

    def flagged(self, percent: int) -> list[int]:
        """Members with any candidate."""
        out = np.zeros(len(self.doc), bool)
        for i in range(len(self.doc) - 1):
            js = self.candidates(i, self.comp, percent)
            if len(js):
                out[i] = out[js] = True
        return np.flatnonzero(out).tolist()

    def links(self, percent: int) -> list[tuple[int, int]]:
        """Links on full sets between members not yet joined, each joining two components."""
        comp, out = self.comp.copy(), []
        for i in range(len(self.doc) - 1):
            js = self.candidates(i, comp, percent)
            if not len(js):
                continue
            mine, sizes = self.sets[i], np.array([len(self.sets[j]) for j in js])
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(js):  # partners of about COMPARED hashes, one at least
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + COMPARED, side="right")))
                part, size = js[lo:hi], sizes[lo:hi]
                lo = hi
                apart = comp[part] != comp[i]  # not joined by a link since
                part, size = part[apart], size[apart]
                if not len(part):
                    continue
                theirs = np.concatenate([self.sets[j] for j in part])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
                for j in part[100 * both >= percent * (len(mine) + size - both)]:
                    if comp[j] != comp[i]:
                        out.append((int(self.doc[i]), int(self.doc[j])))
                        comp[comp == comp[j]] = comp[i]
        return out


def _nodes_of(batches):
    """(node, _Node) one after the other, from rows sorted by node."""
    last, rows = None, []
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            for node, *row in zip(*(c.to_pylist() for c in b.slice(lo, ROWS).columns)):
                if node != last and rows:
                    yield last, _Node(rows)
                    rows = []
                last = node
                rows.append(row)
    if rows:
        yield last, _Node(rows)


def _links_of_small(rows: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links inside nodes of at most ``SMALL`` members, from (node, doc, comp, root, earlier)."""
    def flag(batches):
        for node, x in _nodes_of(batches):
            at = x.flagged(percent)
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(at), pa.int64()), *(pa.array(c[at], pa.int64()) for c in (x.doc, x.comp, x.n)), pa.array([x.root] * len(at), pa.int32()),
                                                  pa.array(x.earlier[at], pa.int64()), pa.array([x.sketch[i].tobytes() for i in at], pa.binary())],
                                                 ["node", "doc", "comp", "n", "root", "earlier", "sketch"])

    def link(batches):
        for _, x in _nodes_of(batches):
            got = x.links(percent)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], ["a", "b"])

    known = rows.join(classes.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sketch"), "doc")
    order = ["node", "doc", "comp", "n", "root", "earlier", "sketch"]
    flagged = materialize(known.select(*order).repartition("node").sortWithinPartitions("node", "doc")
                          .mapInArrow(flag, "node long, doc long, comp long, n long, root int, earlier long, sketch binary"), "flagged")
    if flagged.isEmpty():
        return None
    sets = shingle_sets(docs, flagged.select(F.col("doc").alias("doc_id")).distinct(), size).withColumnRenamed("doc_id", "doc")
    return materialize(flagged.join(sets, "doc").select(*order, "set").repartition("node").sortWithinPartitions("node", "doc").mapInArrow(link, "a long, b long").distinct(), "links")


def _pairs_with_stars(rows: DataFrame, level: int) -> DataFrame:
    """Each member of a large node with representatives: the smallest by orders that all nodes share."""
    ranks = [F.min(F.struct(F.xxhash64("doc", F.lit(level * STARS + k)).alias("o"), "doc", "comp")).alias(f"r{k}") for k in range(STARS)]
    stars = rows.groupBy("node").agg(*ranks)
    one = F.explode(F.array(*[F.col(f"r{k}") for k in range(STARS)])).alias("r")
    return (rows.join(stars, "node").select("doc", "comp", one).filter("comp <> r.comp")
            .select(F.least("doc", "r.doc").alias("a"), F.greatest("doc", "r.doc").alias("b")))


def _pairs_in_blocks(rows: DataFrame) -> DataFrame:
    """All pairs of different components in nodes that stay large: members in blocks, each pair of blocks a group of its own."""
    sized = rows.withColumn("n", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("n")).cast("int"))
    left = sized.select("node", "doc", "comp", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("n") - 1)).alias("j"))
    right = sized.select("node", F.col("doc").alias("doc2"), F.col("comp").alias("comp2"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    return left.join(right, ["node", "i", "j"]).filter("comp <> comp2 and doc <> doc2").select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b"))


def alike(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs that sizes and sketches don't rule out."""
    def task(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
            ok = pa.array((x == y).sum(1) >= AGREE)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in (0, 1)], ["a", "b"])

    one = classes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.distinct().join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return near.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full sets are alike: 100 * intersection >= percent * union."""
    def task(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ok = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], ["a", "b"])

    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), size)
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
    return materialize(pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long").distinct(), "links")


def near_links(classes: DataFrame, docs: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes that link, over all trees."""
    comp = docs.sparkSession.createDataFrame([], "doc long, comp long")
    members = materialize(_branch(classes.select(F.lit(0).cast("long").alias("node"), "doc_id", "sketch"), 0), "nodes")
    found: list[DataFrame] = []

    def open_nodes(rows: DataFrame, least: int) -> DataFrame:
        """Members, with components and node size, of the nodes that hold more than one component."""
        known = rows.join(comp, "doc", "left").select("node", "doc", "root", F.coalesce("comp", "doc").alias("comp"))
        nodes = known.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter(F.col("size") >= least).filter("c0 <> c1").select("node", "size")
        return materialize(known.join(nodes, "node"), "open-nodes")

    def add(links: DataFrame | None) -> bool:
        if links is not None:
            found.append(links)
        return links is not None

    def add_pairs(pairs: DataFrame) -> bool:
        near = materialize(alike(pairs, classes, percent), "pairs")
        return not near.isEmpty() and add(confirm(near, docs, size, percent))

    def join() -> DataFrame:
        return materialize(components(reduce(DataFrame.union, found)).select(F.col("node").alias("doc"), F.col("component").alias("comp")), "components")

    for level in range(DEPTH):
        rows = open_nodes(members, 2)
        if rows.isEmpty():
            break
        small, large = rows.filter(F.col("size") <= SMALL), rows.filter(F.col("size") > SMALL)
        if level:
            small = small.withColumn("earlier", F.lit(0).cast("long"))
        else:  # first nodes that compare all their members, by document
            seen = small.groupBy("doc").agg(F.sum(F.expr("shiftleft(1L, root)")).alias("earlier"))
            small = small.join(seen, "doc")
        new = add(_links_of_small(small, classes, docs, size, percent))
        any_large = not large.isEmpty()
        if any_large:
            new |= add_pairs(_pairs_with_stars(large, level))
        if new:
            comp = join()
        if not any_large:
            break
        large = open_nodes(large.select("node", "doc", "root"), SMALL + 1)
        if large.isEmpty():
            break
        if level < DEPTH - 1:
            members = materialize(_branch(large.join(classes.select(F.col("doc_id").alias("doc"), "sketch"), "doc").select("node", "doc", "sketch"), level + 1).distinct(), "nodes")
        elif add_pairs(_pairs_in_blocks(large)):
            comp = join()
    return comp


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = sketches(docs, size)
    real = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(real.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    comp = near_links(classes.select("doc_id", "n_shingles", "sketch"), docs, size, percent)
    of_class = classes.select("digest", F.col("doc_id").alias("rep")).join(comp.withColumnRenamed("doc", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"))
    linked = F.col("n_shingles") > 0
    out = sets.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(linked & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group."""
    gone = near_duplicates(docs, size, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone, _ = broadcast_if_small(materialize(gone, "gone"))  # beyond the checked size a shuffle join
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def brute_force(rows: list[tuple], size: int = WORDS, percent: int = PERCENT) -> list[tuple]:
    """The contract read literally, for tests: all pairs that share a shingle."""
    import re
    from collections import Counter, defaultdict
    sets, holders = {}, defaultdict(list)
    for key, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        s = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        sets[key] = s
        for x in s:
            holders[x].append(key)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, s in sets.items():
        for other, both in Counter(o for x in s for o in holders[x] if o < k).items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
    return [(k, len(s), find(k), find(k) == k) for k, s in sets.items()]
