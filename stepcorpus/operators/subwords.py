"""T1 with a sub-word vocabulary: byte-pair merges by rank, word type by word type.

A vocabulary file lists byte strings by rank (one ``base64 rank`` pair a line,
as public byte-level tokenizers are published); it is read, never learned
here.  A word starts as its bytes, and of all neighbours whose joined bytes
are in the vocabulary those of the lowest rank merge, the leftmost first, until
none is left; what remains are the word's ids.  A word's ids depend on the word
alone, so they are found once for every **distinct** token of the corpus and
then looked up like whole-word ids: frequent types by broadcast, others by a
join, special tokens in the row.  Special tokens get the ids after the
vocabulary's, in their order.  Any text comes back byte for byte, as every
single byte has a rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.operators.tokens import _look_up, build_vocab
from stepcorpus.session import materialize


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file; raises where a single byte is missing."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(bytes.strip, f))}
    if lost := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary has no rank for the bytes {lost[:5]}")
    return ranks


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        best = min((r for r in found if r is not None), default=None)
        if best is None:
            break
        out, i = [], 0
        while i < len(parts):
            if i < len(found) and found[i] == best:  # all neighbours of the lowest rank, from the left
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return [ranks[p] for p in parts]


def special_pieces(ranks: dict[bytes, int]) -> dict[str, list[int]]:
    first = max(ranks.values()) + 1
    return {t: [first + i] for i, t in enumerate(S.SPECIAL_TOKENS)}


def subword_types(df: DataFrame, tokens: str, ranks: dict[bytes, int]) -> DataFrame:
    """token, token_id, n, pieces of every distinct token (token_id: its place by frequency); written."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file
    special = special_pieces(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(pieces=[special.get(t) or merged(t.encode(), shared.value) for t in pdf["token"]])

    vocab = build_vocab(df, tokens).select("token", "token_id", "n")
    spread = vocab.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")
    return materialize(spread.mapInPandas(run, "token string, token_id long, n long, pieces array<long>"), "subword-types")


def encode_subwords(df: DataFrame, tokens: str, types: DataFrame, ranks: dict[bytes, int], key: str, out: str = "input_ids") -> DataFrame:
    """Token strings -> sub-word ids in order, for rows with a unique ``key``."""
    got = _look_up(df, tokens, "token", "pieces", types, key, special_pieces(ranks))
    return got.withColumn(out, F.coalesce(F.flatten("_got"), F.array().cast("array<bigint>"))).drop("_got")


def vocabulary(spark, ranks: dict[bytes, int]) -> DataFrame:
    """token_id, bytes of every id, the special tokens' included."""
    special = {i[0]: t.encode() for t, i in special_pieces(ranks).items()}
    rows = [(i, bytearray(w)) for w, i in ranks.items()] + [(i, bytearray(w)) for i, w in special.items()]
    return spark.createDataFrame(rows, "token_id long, bytes binary")


def decode_subwords(df: DataFrame, ids: str, ranks: dict[bytes, int], key: str, out: str = "text") -> DataFrame:
    """Ids -> text (``key`` unique).  A piece may be part of a character, so bytes are joined before they are read."""
    special = {i[0]: bytearray(t.encode()) for t, i in special_pieces(ranks).items()}
    got = _look_up(df, ids, "token_id", "bytes", vocabulary(df.sparkSession, ranks), key, special)
    joined = F.aggregate("_got", F.lit(bytearray()), lambda a, b: F.concat(a, b))
    return got.withColumn(out, F.coalesce(F.decode(joined, "UTF-8"), F.lit(""))).drop("_got")
