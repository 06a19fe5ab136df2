"""Exact top-k search by tiled matrix products.

Queries are dealt into blocks and candidates into shards by a hash of their
row number.  A tile is one block against one shard: a task multiplies the two
matrices piece by piece, keeps of each piece every query's k best, and emits
at most k rows a query and tile.  The tiles' lists of a query are merged as
a tree, ``FAN`` lists to one a level, so no task holds more than ``FAN * k``
rows of a query.  Every query meets every shard once: the work is the
product of both sides, as an exact search asks, but nothing but k rows a
query and tile leaves a task.

A component x becomes floor(256 * x), x as double.  Products are exact: in
float64 while the sums stay under 2**53, in whole Python numbers beyond;
a score outside a long is taken as the nearest long.

Rows whose vector is null or holds a null, NaN or infinite component take no
part, nor do rows without an id.  An empty vector scores 0 with all; of two
vectors of different lengths the shorter is taken to end in zeros.  Rows that
share an id are rows of their own: each is a query if its id is, and each a
candidate of the others; equal scores go to the smaller id, and rows of one
id with one score count separately.  A query of a repeated id returns one list
a row.  Very long vectors are handled piece by piece; a vector must fit a
task.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepcorpus.session import materialize

K = 5
EVERY = 50  # queries: ids divisible by it
SCALE = 256.0
SHARD_ROWS = 32_768  # candidates of a tile; with BLOCK_ROWS the bytes that a task holds
BLOCK_ROWS = 16_384  # queries of a tile
PIECE = (512, 4096)  # queries and candidates multiplied at once, fewer of vectors
PIECE_BYTES = 16 << 20  # whose matrix would be larger than this
FAN = 32
EXACT = 2 ** 53  # whole numbers up to this are exact in float64
LONG = 2 ** 63

_HITS = "query_row long, query_id long, shard long, vec_id long, row long, score long"


def usable(vector: str) -> Column:
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of floor(256 x) as float64, ended by zeros to ``width``."""
    col = column.combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    lengths = np.diff(col.offsets.to_numpy())
    flat = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(col), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _width(table: pa.Table, name: str) -> int:
    return max((len_ for chunk in table.column(name).chunks for len_ in np.diff(chunk.offsets.to_numpy())), default=0)


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("vec_id", "ascending"), ("row", "ascending")])


def _best_floats(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) positions of each row's k best; candidates stand in the order of ties."""
    n = scores.shape[1]
    keys = scores * n + (n - 1 - np.arange(n))  # one number for score and place, exact by the caller's bound
    keys[own] = -np.inf
    k = min(k, n)
    part = np.argpartition(keys, n - k, axis=1)[:, n - k:] if k < n else np.tile(np.arange(n), (len(keys), 1))
    rows = np.repeat(np.arange(len(keys)), k)
    cols = part.ravel()
    there = keys[rows, cols] > -np.inf
    return rows[there], cols[there]


def _long(score: int) -> int:
    return min(max(score, -LONG), LONG - 1)


def _best_exact(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) of the same in whole Python numbers, a query at a time."""
    whole = [[int(x) for x in row] for row in c]
    for i, row in enumerate(q):
        mine = [int(x) for x in row]
        ranked = sorted((-_long(sum(a * b for a, b in zip(mine, other))), j) for j, other in enumerate(whole) if not own[i, j])
        yield from ((i, j, -s) for s, j in ranked[:k])


def _tile(k: int):
    def run(key: tuple, queries: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        number = key[1].as_py()
        if queries.num_rows and shard.num_rows:
            queries, shard = _sorted(queries), _sorted(shard)
            width = max(_width(queries, "vector"), _width(shard, "vector"))
            q_row, q_id = queries.column("row").to_numpy(), queries.column("vec_id").to_numpy()
            c_row, c_id = shard.column("row").to_numpy(), shard.column("vec_id").to_numpy()
            n_q, n_c = (min(n, max(1, PIECE_BYTES // (8 * max(width, 1)))) for n in PIECE)
            for a in range(0, len(q_row), n_q):
                q = _matrix(queries.column("vector").slice(a, n_q), width)
                rows_q = q_row[a:a + n_q]
                for b in range(0, len(c_row), n_c):
                    c = _matrix(shard.column("vector").slice(b, n_c), width)
                    rows_c = c_row[b:b + n_c]
                    own = rows_q[:, None] == rows_c[None, :]
                    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(width, 1)
                    if (top + 1) * len(c) < EXACT:
                        scores = q @ c.T
                        i, j = _best_floats(scores, own, k)
                        s = scores[i, j].astype(np.int64)
                    else:
                        hits = list(_best_exact(q, c, own, k))
                        i, j = (np.array([h[n] for h in hits], dtype=np.int64) for n in (0, 1))
                        s = np.array([h[2] for h in hits], dtype=np.int64)
                    out.append((rows_q[i], q_id[a:a + n_q][i], c_id[b:b + n_c][j], rows_c[j], s))
        cols = [np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64) for n in range(5)]
        qr, qi, ci, cr, s = cols
        return pa.table({"query_row": qr, "query_id": qi, "shard": np.full(len(qr), number, np.int64), "vec_id": ci, "row": cr, "score": s})
    return run


def _merged(hits: DataFrame, lists: int, k: int) -> DataFrame:
    """Each query's k best of ``hits``, ``FAN`` lists to one a level."""
    order = (F.col("score").desc(), F.col("vec_id"), F.col("row"))
    while True:
        best = Window.partitionBy("query_row", "shard").orderBy(*order)
        hits = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        if lists <= 1:
            return hits
        hits, lists = hits.withColumn("shard", F.floor(F.col("shard") / FAN).cast("long")), -(-lists // FAN)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest integer inner product with each query row."""
    spark = vectors.sparkSession
    wide = F.col(vector).cast("array<double>") if dict(vectors.dtypes)[vector] != "array<float>" else F.col(vector)
    rows = materialize(vectors.filter(F.col(vec_id).isNotNull() & usable(vector))
                       .select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), wide.alias("vector")), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    shards = max(-(-n // SHARD_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-n_queries // BLOCK_ROWS))
    dealt = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long").alias("shard")
    block = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("long").alias("block")
    queries = rows.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "vector", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    candidates = rows.select("row", "vec_id", "vector", dealt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    hits = queries.groupBy("block", "shard").cogroup(candidates.groupBy("block", "shard")).applyInArrow(_tile(k), _HITS)
    # a tile's pieces give several lists with one shard number; the first level of the tree merges them
    return _merged(hits, shards, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(rows: list[tuple], k: int = K, every: int = EVERY) -> list[tuple]:
    """The literal search over (vec_id, vector) rows."""
    from math import floor, isfinite
    use = [(i, v, [floor(SCALE * float(x)) for x in vec]) for i, (v, vec) in enumerate(rows)
           if v is not None and vec is not None and all(x is not None and isfinite(x) for x in vec)]
    out = []
    for i, v, q in use:
        if v % every == 0:
            ranked = sorted((-_long(sum(a * b for a, b in zip(q, c))), w) for j, w, c in use if j != i)[:k]
            out += [(v, r + 1, w, -s) for r, (s, w) in enumerate(ranked)]
    return sorted(out)


SQL = f"""
with v as (select row_number() over () as r, vec_id, embedding as e from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
c as (select r, vec_id, unnest(list_transform(e, lambda x: floor({SCALE} * x::double)::bigint)) as x, unnest(generate_series(1, len(e))) as d from v),
ids as (select q.r as qr, q.vec_id as query_id, w.r as wr, w.vec_id from v q join v w on q.r <> w.r where q.vec_id % {EVERY} = 0),
s as (select a.r as qr, b.r as wr, sum(a.x * b.x) as score from c a join c b on a.d = b.d and a.r <> b.r where a.vec_id % {EVERY} = 0 group by all),
k as (select query_id, vec_id, coalesce(score, 0)::bigint as score, row_number() over (partition by qr order by coalesce(score, 0) desc, vec_id, wr) as n
  from ids left join s using (qr, wr))
select query_id, n::integer as rank, vec_id, score from k where n <= {K}
"""
