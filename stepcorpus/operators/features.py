"""token/feature joins and vector operators.

Everything that joins is an equi join on ``(sample_id, position)`` keys;
vector arithmetic stays in array functions, Summarizer (MLlib, a real
aggregate with partial aggregation) or, for the small MLP, NumPy inside
``mapInPandas`` with the weights shipped once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepcorpus.functions.arrays import explode_rows


def vec_sum(v: Column) -> Column:
    """Sum of an array's elements in double (a cheap fingerprint)."""
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))


HEAD_IDS = 1024  # most frequent ids, whose vectors every task holds (a vector of 4096 floats: 16 MB)


def lookup_embeddings(tokens: DataFrame, codebook: DataFrame, token_id: str = "token_id",
                      code_id: str = "vec_id", vector: str = "embedding", out: str = "vector",
                      head: int = HEAD_IDS) -> DataFrame:
    """Token id -> vector (left join; ids without an entry get null).

    Ids are in order of frequency, the specials first, so positions with an
    id below ``head`` are most rows and all hot keys.  They take their vectors
    from a broadcast of that many codebook rows and are never shuffled; the
    others are joined on the id.  The codebook has one row per id."""
    cb = codebook.select(F.col(code_id).alias(token_id), F.col(vector).alias(out))
    frequent = F.coalesce(F.col(token_id) < head, F.lit(False))
    near = tokens.filter(frequent).join(F.broadcast(cb.filter(F.col(token_id) < head)), token_id, "left")
    return near.unionByName(tokens.filter(~frequent).join(cb.filter(F.col(token_id) >= head), token_id, "left"))


def pad_ordinals(arrays: DataFrame, key: str, tokens: str, pad: Column) -> DataFrame:
    """Positions of the image-pad tokens per sample with their ordinal k,
    computed inside the row (no window, no shuffle)."""
    n = F.size(tokens)
    pos = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
                   lambda i: F.get(F.col(tokens), i) == pad)
    return explode_rows(arrays, pos, [key], "k", "pos")


def scatter_features(pads: DataFrame, features: DataFrame, key: str, feat_key: str = "image_id",
                     feat_idx: str = "patch_idx") -> DataFrame:
    """The k-th pad position of a sample takes feature row k of its image;
    pads without a feature row keep the text vector (``patch_idx`` null)."""
    f = features.select(F.col(feat_key).alias(key), F.col(feat_idx).alias("k"), F.col(feat_idx).alias(feat_idx),
                        *[c for c in features.columns if c not in (feat_key, feat_idx)])
    return pads.join(f, [key, "k"], "left")


def scatter_features_in_batch(pads: DataFrame, features: DataFrame, samples: DataFrame, key: str, batch: str, slot: str,
                              feat_key: str = "image_id", feat_idx: str = "patch_idx") -> DataFrame:
    """J2 as the model does it: the features of all images of a batch, in the order of the slots, fill the pads of the
    batch in their order, so pad n of the **batch** takes feature n even where a sample has more or fewer pads
    than its image has features.  ``samples`` (key, batch, slot) places every sample; ``pads`` are (key, k, pos).
    Adds ``n``, the batch-wide number of the pad, and the feature's ``feat_key`` and columns (null without one).

    Per sample only its two counts are summed over the batch (at most a batch of rows); pads and features take
    their sample's start and meet on (batch, n)."""
    counts = (samples.select(key, batch, slot).join(pads.groupBy(key).agg(F.count(F.lit(1)).alias("_pads")), key, "left")
              .join(features.groupBy(F.col(feat_key).alias(key)).agg(F.count(F.lit(1)).alias("_features")), key, "left"))
    before = Window.partitionBy(batch).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)  # a row a sample of one batch
    start = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(before), F.lit(0))
    starts = counts.select(key, batch, start("_pads").alias("_pad0"), start("_features").alias("_feature0"))
    numbered = pads.join(starts, key).withColumn("n", F.col("_pad0") + F.col("k")).drop("_pad0", "_feature0")
    own = Window.partitionBy(feat_key).orderBy(feat_idx)  # the patches of one image, as many as the encoder gives
    f = (features.withColumn("_k", F.row_number().over(own) - 1).join(starts.withColumnRenamed(key, feat_key), feat_key)
         .withColumn("n", F.col("_feature0") + F.col("_k")).drop("_k", "_pad0", "_feature0"))
    return numbered.join(f, [batch, "n"], "left")


def first_pad(tokens: Column, pad: Column) -> Column:
    """J3 (part 1): the first pad position of a row's tokens, -1 without one."""
    return F.coalesce(F.array_position(tokens, pad) - 1, F.lit(-1))


def insert_first_pad(samples: DataFrame, pooled: DataFrame, key: str, pooled_key: str = "image_id") -> DataFrame:
    """Only the first pad position (``first_pad``) receives the pooled image
    vector; samples without a pad (-1) stay unchanged."""
    return samples.join(pooled.withColumnRenamed(pooled_key, key), key, "left")


def regroup_patches(patches: DataFrame, r: int = 3, key: str = "image_id", idx: str = "patch_idx",
                    vector: str = "embedding") -> DataFrame:
    """Concatenate every r consecutive patch vectors of an image.  An
    image whose patch count is not a multiple of r cannot be reshaped; its
    rows come back with ``status = 'not_divisible'`` instead of failing.

    Rows are grouped by (image, group) first, so even an image with a third
    of all patches is spread over many tasks; the per-image patch count is a
    partial aggregate over those groups, joined back on the image."""
    grouped = (patches.groupBy(key, F.floor(F.col(idx) / F.lit(r)).cast("int").alias("group_idx"))
               .agg(F.count(F.lit(1)).alias("_c"),
                    F.array_sort(F.collect_list(F.struct(idx, vector))).alias("_g")))
    per_image = grouped.groupBy(key).agg(F.sum("_c").alias("_n"))
    ok = F.col("_n") % r == 0
    return grouped.join(per_image, key).select(
        key, "group_idx", F.when(ok, F.lit("ok")).otherwise(F.lit("not_divisible")).alias("status"),
        F.when(ok, F.flatten(F.transform("_g", lambda s: s[vector]))).alias("vector"))


def pool_patches(patches: DataFrame, key: str = "image_id", idx: str = "patch_idx",
                 vector: str = "embedding") -> DataFrame:
    """``[first patch, mean, max]`` per image (length 3d).  Mean and max
    come from MLlib's Summarizer, a partial-aggregating vector aggregate."""
    v = patches.select(key, idx, vector, array_to_vector(F.col(vector)).alias("_v"))
    summ = Summarizer.metrics("mean", "max")
    agg = v.groupBy(key).agg(F.min_by(F.col(vector), F.col(idx)).alias("_first"),
                             summ.summary(F.col("_v")).alias("_s"))
    first = F.transform("_first", lambda x: x.cast("double"))
    return agg.select(key, F.concat(first, vector_to_array(F.col("_s.mean")),
                                    vector_to_array(F.col("_s.max"))).alias("pooled"))


# ------------------------------------------------------------------ J6 (MLP)

def rule_matrix(rows: int, cols: int, scale: float, freq: float, phase: float = 0.0) -> np.ndarray:
    """Deterministic weights ``scale * sin(freq * (r * cols + c) + phase)``:
    reproducible anywhere (the SQL oracle builds the same matrix)."""
    r = np.arange(rows)[:, None]
    c = np.arange(cols)[None, :]
    return scale * np.sin(freq * (r * cols + c) + phase)


def rule_vector(n: int, scale: float, freq: float, phase: float = 0.0) -> np.ndarray:
    return scale * np.cos(freq * np.arange(n) + phase)


def _act(name: str, x: np.ndarray) -> np.ndarray:
    if name == "silu":
        return x / (1.0 + np.exp(-x))
    if name == "relu":
        return np.maximum(x, 0.0)
    raise ValueError(name)


def project(df: DataFrame, vector: str, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray,
            act: str = "silu", out: str = "projected") -> DataFrame:
    """``W2 · act(W1 · x + b1) + b2`` per row, as NumPy matrix products
    over each Arrow batch (the weights travel in the task closure once)."""
    schema = df.select("*", F.lit(None).cast("array<double>").alias(out)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                pdf[out] = []
                yield pdf
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]])
            h = _act(act, x @ w1.T + b1)
            y = h @ w2.T + b2
            pdf[out] = list(y)
            yield pdf

    return df.mapInPandas(run, schema)
