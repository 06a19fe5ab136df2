"""S1 on large files: one JSON array read by many tasks.

A JSON array has no record separator that can be found by looking at a
place alone: a brace may stand in a string, and a string may hold any text.
The reader cuts a file at every ``}`` (a text scan with that separator, which
Spark splits by byte ranges like lines) and works in two scans:

1. every range reports what it does to the parser's state, for both states
   it may start in (outside or inside a string): whether it flips the state,
   and by how much it moves the nesting depth;
2. a running sum over the ranges of a file (one row each) gives the state
   and depth that each really starts with;
3. the ranges are read again, now with their start, and every task cuts its
   range into whole records.  Parts of records that cross the bounds of
   ranges are joined by place.

No task holds more than a batch of its range and one record.  Works with any
file system that Spark reads.  A record is an object in the file's top-level
array, or at the top level of a file that starts with an object.  Elements
that are no objects are no records.  Each record is parsed as Spark parses a
JSON line: one that doesn't fit the schema has nulls.  Files without a record
(empty, blank, ``[]``) give no rows.  Text must be UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepcorpus.session import broadcast_if_small, materialize

CLOSE = "}"
QUOTE, ESCAPE, OPEN, END = 0x22, 0x5C, 0x7B, 0x7D
SLICE_BYTES = 1 << 20  # of text looked at once; a longer piece stands alone
#: How far each byte moves the nesting depth outside of strings.
_MOVES = np.zeros(256, np.int8)
_MOVES[[0x7B, 0x5B]] = 1
_MOVES[[0x7D, 0x5D]] = -1
_BLANK = b" \t\r\n"
_MARK = b"\xef\xbb\xbf"  # a byte order mark


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (the range's start), piece: the text between closing braces, in file order within a task."""
    raw = spark.read.option("lineSep", CLOSE).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _real_quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes.  A text cut at braces never starts within an escape."""
    at = np.flatnonzero(data == QUOTE)
    after = at[(at > 0) & (data[np.maximum(at - 1, 0)] == ESCAPE)]
    if not len(after):
        return at
    run_ends = np.flatnonzero(data != ESCAPE)
    before = np.searchsorted(run_ends, after - 1)  # the last byte before each run of backslashes
    start = np.where(before > 0, run_ends[np.maximum(before - 1, 0)], -1)
    escaped = after[(after - 1 - start) % 2 == 1]
    return np.setdiff1d(at, escaped, assume_unique=True)


def _inside(data: np.ndarray) -> np.ndarray:
    """Whether each byte lies in a string, if the text starts outside one (quotes count as either)."""
    flips = np.zeros(len(data), bool)
    flips[_real_quotes(data)] = True
    return np.logical_xor.accumulate(flips)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, first row, text) of runs of pieces of one range, a brace after every piece, each of about
    ``SLICE_BYTES``."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
    pieces = batch.column("piece")
    lo = 0
    while lo < len(files):
        text, hi, size = [], lo, 0
        while hi < len(files) and blocks[hi] == blocks[lo] and files[hi] == files[lo] and size < SLICE_BYTES:
            text.append(pieces[hi].as_py())
            size += len(text[-1]) + 1
            hi += 1
        yield files[lo], int(blocks[lo]), lo, b"}".join(text) + b"}"
        lo = hi


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, flips, outside, inside, array: what a range does to the state (flips it or not) and to the
    depth if it starts outside or inside a string; ``array``: its first character is ``[``."""
    held: list | None = None
    out: list[list] = []
    for batch in batches:
        for file, block, _, text in _runs(batch):
            data = np.frombuffer(text, np.uint8)
            within, moves = _inside(data), _MOVES[data]
            outside, inside = (int(moves[x].sum(dtype=np.int64)) for x in (~within, within))
            flips = bool(within[-1]) if len(within) else False
            if held is None or held[:2] != [file, block]:
                if held is not None:
                    out.append(held)
                held = [file, block, False, 0, 0, None]
            if held[5] is None and (head := text.removeprefix(_MARK).lstrip(_BLANK)):
                held[5] = head[:1] == b"["
            if held[2]:
                outside, inside = inside, outside
            held[2:5] = [held[2] ^ flips, held[3] + outside, held[4] + inside]
        if out:
            yield _rows(out)
            out = []
    if held is not None:
        yield _rows([held])


def _rows(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "block", "flips", "outside", "inside", "array"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, kind, record: whole records (kind 1), and the parts of those that cross a range's bounds: the
    end of one that begins before (0), the beginning of one that ends after (2), the inside of one (3)."""
    key = rest = None  # rest: the text since the last record's beginning, if it hasn't ended
    depth, within, base, begun, ended = 0, False, 1, False, False
    out: list[tuple] = []

    def last() -> list[tuple]:
        return [(*key, 2 if begun else 3, b"".join(rest))] if begun or not ended else []

    for batch in batches:
        columns = {n: batch.column(n) for n in ("start_depth", "start_inside", "base")}
        for file, block, row, text in _runs(batch):
            if key != (file, block):
                if key is not None:
                    out += last()
                key, rest, begun, ended = (file, block), [], False, False
                depth, within, base = (columns[n][row].as_py() for n in ("start_depth", "start_inside", "base"))
            data = np.frombuffer(text, np.uint8)
            inside = _inside(data) ^ within
            places = np.flatnonzero((_MOVES[data] != 0) & ~inside)
            kinds, depths = data[places], depth + np.cumsum(_MOVES[data[places]], dtype=np.int64)
            begins = places[(kinds == OPEN) & (depths == base + 1)].tolist()
            ends = places[(kinds == END) & (depths == base)] + 1
            at = begun_at = 0
            for end in [*ends.tolist(), None]:
                while begun_at < len(begins) and (end is None or begins[begun_at] < end):
                    rest, at, begun = [], begins[begun_at], True
                    begun_at += 1
                rest.append(text[at:end])
                if end is not None:
                    out.append((*key, 1 if begun else 0, b"".join(rest)))
                    rest, at, begun, ended = [], end, False, True
            depth, within = int(depths[-1]) if len(depths) else depth, bool(inside[-1])
        yield _fragments(out)
        out = []
    if key is not None:
        yield _fragments(last())


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["file", "block", "kind", "record"])


def range_starts(pieces: DataFrame) -> DataFrame:
    """file, block, start_depth, start_inside, base: the parser's state at the start of every range; written."""
    effects = materialize(pieces.mapInArrow(_effects, "file string, block long, flips boolean, outside long, inside long, array boolean"), "ranges")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    inside = F.coalesce(F.sum(F.col("flips").cast("int")).over(earlier), F.lit(0)) % 2 == 1
    states = effects.withColumn("start_inside", inside).withColumn("moved", F.when(F.col("start_inside"), F.col("inside")).otherwise(F.col("outside")))
    first = F.first("array", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return materialize(states.select("file", "block", F.coalesce(F.sum("moved").over(earlier), F.lit(0)).alias("start_depth"), "start_inside", F.coalesce(first, F.lit(True)).cast("long").alias("base")), "starts")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record: the text of every object of the JSON arrays below ``path``."""
    pieces = _pieces(spark, path)
    starts, _ = broadcast_if_small(range_starts(pieces))
    located = pieces.join(starts, ["file", "block"])
    found = materialize(located.select("file", "block", "piece", "start_depth", "start_inside", "base").mapInArrow(_records, "file string, block long, kind int, record binary"), "records")
    fragments = found.filter("kind <> 1")
    # a record that crosses ranges: its beginning, whole ranges without an end, its end
    so_far = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # two rows a range at most
    crossing = fragments.select("file", "block", "kind", "record", F.max(F.when(F.col("kind") == 2, F.col("block"))).over(so_far).alias("chain"))
    whole = (crossing.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"), F.max((F.col("kind") == 0).cast("int")).alias("ended"))
             .filter("ended = 1").select("file", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["record"])).alias("record")))  # one record's parts
    return found.filter("kind = 1").select("file", "record").unionByName(whole).select("file", F.col("record").cast("string").alias("record"))


def read_array_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of files that each hold one JSON array, read by as many tasks as the files have ranges."""
    return read_records(spark, path).select(F.from_json("record", schema).alias("r")).select("r.*")


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun = False
    for batch in batches:
        lines = batch.column(0).to_pylist()
        if lines:
            out = [("," if begun or i else "[") + line for i, line in enumerate(lines)]
            begun = True
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])


def write_array_files(df: DataFrame, path: str, key: str, files: int) -> None:
    """``files`` files of one JSON array each; every task streams its rows into one, none holds an array."""
    records = df.repartition(files, F.xxhash64(key)).select(F.to_json(F.struct(*df.columns)).alias("value"))
    records.mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)
