"""Arrow batches of texts as flat byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18  # of text handled at once in a task; a longer single text stands alone


def as_bytes(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Only ``keys`` and the text, the latter as UTF-8 bytes (null stays null)."""
    return df.select(*keys, F.col(text).cast("binary").alias("text"))


def byte_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; a null is an empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null(pa.scalar(b"").cast(col.type))
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) \
        if offsets is not None and len(col) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows holding about ``limit`` bytes."""
    data, at = byte_column(batch, name)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def spans_of(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd, so that powers have inverses modulo 2**64 and a hash of any stretch comes from two prefix sums.
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept up to the slice size, built anew beyond it."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = max(n, 1 << 16)
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    if size <= 16 * SLICE_BYTES:
        _POWERS[:] = [up, down]
    return up[:n], down[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[0] = 0; the stretch [i, j) hashes to mix64((S[j] - S[i]) * BASE**-i)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((mix64(np.arange(1, 257, dtype=np.uint64)))[data] * powers(len(data))[0], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix64((prefix[hi] - prefix[lo]) * powers(len(prefix))[1][lo])


SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(range(256)).lower()


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts: starts, ends, and the first word of each text (and the end)."""
    inside = ~SPACES[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        edge = np.zeros(len(data) + 1, bool)
        edge[cut] = True
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    low = np.frombuffer(LOWER, np.uint8)[data]
    return stretch_hash(prefix_hash(low), starts, ends)
