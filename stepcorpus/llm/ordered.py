"""Hashes of ordered pieces, group by group, for groups of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepcorpus.session import materialize

EMPTY = hashlib.sha256(b"").hexdigest()


def _joined(keys: Sequence[str], order: str, sep: bytes):
    """Sorted pieces as one text for each group of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy() for n in (*keys, order)]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:-1]], axis=0)) + 1
            starts = [0, *cuts.tolist()]
            pieces = batch.column("piece").to_pylist()
            texts = [sep.join(pieces[a:b]) for a, b in zip(starts, [*starts[1:], len(pieces)])]
            yield pa.RecordBatch.from_arrays([pa.array(c[starts]) for c in cols] + [pa.array(texts, pa.binary())], [*keys, order, "piece"])
    return run


def _hashed(keys: Sequence[str], out: str, sep: bytes):
    """Sorted texts as one hash a group; the state goes from batch to batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *now, piece in zip(*(batch.column(n).to_pylist() for n in (*keys, "piece"))):
                if now == key:
                    state.update(sep)
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*keys, out])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], [*keys, out])
    return run


def hash_in_order(rows: DataFrame, keys: Sequence[str], order: str, out: str, sep: str) -> DataFrame:
    """``keys`` and ``out``: the SHA-256 of each group's ``piece``s (binary) in ``order``, joined by ``sep``.

    ``keys`` and ``order`` are longs.  Rows are range-partitioned by (keys, order), so a group with a third of
    them spans many tasks; each joins its pieces batch by batch, and only these texts meet, one stream a group,
    as a hash of one text asks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place, longs = [*keys, order], ", ".join(f"{c} long" for c in keys)
    texts = materialize(rows.select(*place, "piece").repartitionByRange(n, *place).sortWithinPartitions(*place)
                        .mapInArrow(_joined(keys, order, sep.encode()), f"{longs}, {order} long, piece binary"), "pieces")
    return texts.repartition(n, *keys).sortWithinPartitions(*place).mapInArrow(_hashed(keys, out, sep.encode()), f"{longs}, {out} string")
