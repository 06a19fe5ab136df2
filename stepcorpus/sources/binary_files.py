"""Rows as files, one each, and a raster encoder for them.

Spark has sources for images and binary files but no sink.  ``write_files``
writes a row's bytes under a name of the attempt in ``_parts`` and then moves
them to the row's own name, which replaces what an earlier attempt may have
left: a task that runs twice, or beside a slower copy of itself, leaves the
same files, and a reader never sees half of one.  Names that begin with
``_`` aren't listed by Spark.  A row is written when its name is committed;
the returned table, itself written by Spark, lists what is there.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepcorpus.session import materialize

SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR_TYPE = {1: 0, 2: 4, 3: 2, 4: 6}  # by channels
FOLDERS_AT_ONCE = 4096  # created names held by a task


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def png(width: int, height: int, channels: int, pixels: bytes) -> bytes:
    """An 8-bit image file with rows as they are (no filter, no compression)."""
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width * channels)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPE[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 0)) + chunk(b"IEND", b"")


def png_column(width: Column, height: Column, channels: Column, pixels: Column) -> Column:
    """Image files of pixel arrays (numbers 0 to 255, row by row)."""
    @F.pandas_udf("binary")
    def encode(w: pd.Series, h: pd.Series, c: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([png(*size, np.asarray(px, np.uint8).tobytes()) for *size, px in zip(w, h, c, p)], dtype=object)
    return encode(width, height, channels, pixels)


def write_files(df: DataFrame, root: str, name: str, content: str) -> DataFrame:
    """``df``'s ``content`` (binary) as files below ``root`` named by ``name`` (a relative path); returns the
    written table of ``name`` and ``length``.  Rows of one name must have one content.  Null names or contents
    raise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        made: set[str] = set()
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for file, data in zip(names, contents):
                if file is None or data is None or file.startswith("/") or ".." in file.split("/"):
                    raise ValueError(f"no file can be written as {file!r}")
                target, part = f"{base}/{file}", f"{base}/_parts/{uuid.uuid4().hex}"
                for folder in (target.rpartition("/")[0], f"{base}/_parts"):
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made = made if len(made) < FOLDERS_AT_ONCE else set()
                        made.add(folder)
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(c) for c in contents], pa.int64())], ["name", "length"])

    return materialize(df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, length long"), "files")
