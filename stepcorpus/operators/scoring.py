"""Verification head, losses, selection and checkpoint metrics.

Losses use a stable log-sum-exp (subtract the group maximum first).  Every
group here is one position's score list or one run's metric rows, so the
windows stay bounded; selection (top-k, argmax, sampling) is per group with
no global sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepcorpus.functions.ranking import seeded_uniform


ERF_STEP, ERF_END = 1024, 6  # table places a unit; beyond the end erf is 1 to 16 places
_GRID = np.arange(ERF_STEP * ERF_END + 1) / ERF_STEP
_ERF = np.array([erf(x) for x in _GRID])
_SLOPE = 2.0 / sqrt(pi) * np.exp(-_GRID * _GRID)


def erf_of(x: np.ndarray) -> np.ndarray:
    """erf of a whole array: the nearest table place and four terms of the series around it.

    With d <= 1/2048 from a place the first term left out is below 4e-17, so the error is that of float64
    sums (about 3e-16; tests hold it under 1e-15).  NaN stays NaN."""
    size = np.minimum(np.abs(x), ERF_END)
    at = np.rint(np.where(np.isnan(size), 0.0, size) * ERF_STEP).astype(np.int64)
    x0, d = _GRID[at], size - _GRID[at]
    tail = d * (1.0 - d * (x0 - d * ((2.0 * x0 * x0 - 1.0) / 3.0 + d * (3.0 * x0 - 2.0 * x0 ** 3) / 6.0)))
    return np.copysign(_ERF[at] + _SLOPE[at] * tail, x)


def gelu(x: np.ndarray) -> np.ndarray:
    """Exact (erf) GELU, the default of the head's activation."""
    return 0.5 * x * (1.0 + erf_of(x / sqrt(2.0)))


def head_forward(x: np.ndarray, w_dense, b_dense, w_cls, b_cls, eps: float = 1e-5) -> np.ndarray:
    """dense -> GELU -> LayerNorm (unit scale, zero shift) -> 2 logits."""
    h = gelu(x @ w_dense.T + b_dense)
    mu = h.mean(axis=1, keepdims=True)
    var = h.var(axis=1, keepdims=True)
    h = (h - mu) / np.sqrt(var + eps)
    return h @ w_cls.T + b_cls


def score_steps(df: DataFrame, vector: str, w_dense, b_dense, w_cls, b_cls) -> DataFrame:
    """M1: batch inference of the step-verification head (class 1 = correct).
    Adds ``logit_0``, ``logit_1`` and ``p_correct``."""
    schema = df.select("*", F.lit(0.0).alias("logit_0"), F.lit(0.0).alias("logit_1"),
                       F.lit(0.0).alias("p_correct")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(logit_0=[], logit_1=[], p_correct=[])
                continue
            x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            logits = head_forward(x, w_dense, b_dense, w_cls, b_cls)
            m = logits.max(axis=1, keepdims=True)
            p = np.exp(logits - m)
            p = p / p.sum(axis=1, keepdims=True)
            yield pdf.assign(logit_0=logits[:, 0], logit_1=logits[:, 1], p_correct=p[:, 1])

    return df.mapInPandas(run, schema)


def fit_step_verifier(df: DataFrame, features: str, label: str, max_iter: int = 100, reg: float = 0.0,
                      standardization: bool = True, tol: float = 1e-6):
    """M2: distributed logistic regression on frozen step features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    data = df.withColumn("_features", array_to_vector(F.col(features)))
    lr = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=reg,
                            standardization=standardization, tol=tol)
    return lr.fit(data.withColumn(label, F.col(label).cast("double"))), data


def optimality(data: DataFrame, features: str, label: str, weights: np.ndarray, bias: float, reg: float) -> DataFrame:
    """M2's certificate at a fit: one row a parameter (``feature``; the bias is the last) with the ``gradient``
    and the diagonal ``curvature`` of mean log loss + reg / 2 * |weights|^2, and ``loss``, ``n``, ``n_pos``.

    The loss is convex, so a fit is optimal where all gradients are 0.  One pass: every Arrow batch gives one
    row of sums, and only these are added up.  Unregularized weights are not judged on separable data, where no
    optimum exists."""
    width = len(weights) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.stack(pdf[features].to_numpy()).astype(np.float64), np.ones(len(pdf))])
                y = pdf[label].to_numpy(np.float64)
                z = x @ np.append(weights, bias)
                p = np.where(z >= 0, 1.0, np.exp(-np.abs(z))) / (1.0 + np.exp(-np.abs(z)))
                loss = np.maximum(z, 0.0) - z * y + np.log1p(np.exp(-np.abs(z)))
                yield pd.DataFrame({"g": [(p - y) @ x], "c": [(p * (1.0 - p)) @ (x * x)], "l": [loss.sum()], "n": [len(y)], "n_pos": [int(y.sum())]})

    parts = data.select(features, label).mapInPandas(run, "g array<double>, c array<double>, l double, n long, n_pos long")
    sums = parts.agg(*(F.array(*(F.sum(F.col(a)[j]) for j in range(width))).alias(a) for a in ("g", "c")), *(F.sum(a).alias(a) for a in ("l", "n", "n_pos")))
    own = F.array(*(F.lit(float(w) * reg) for w in weights), F.lit(0.0))
    ridge = F.array(*(F.lit(float(reg)) for _ in weights), F.lit(0.0))
    square = float(reg / 2 * np.dot(weights, weights))
    return sums.select(F.posexplode(F.arrays_zip("g", "c", own.alias("o"), ridge.alias("r"))).alias("feature", "v"), "l", "n", "n_pos").select(
        "feature", (F.col("v.g") / F.col("n") + F.col("v.o")).alias("gradient"), (F.col("v.c") / F.col("n") + F.col("v.r")).alias("curvature"), (F.col("l") / F.col("n") + square).alias("loss"), "n", "n_pos")


def token_nll(scores: DataFrame, labels: DataFrame, pos_key: str, batch: str, ignore: int,
              item: str = "item", score: str = "score", label: str = "label") -> DataFrame:
    """M3: mean cross-entropy per batch over positions whose label is not
    ``ignore``.  A batch whose labels are all ignored has no loss (null).
    ``n_unmatched`` counts, by batch, the labels that no score belongs to;
    scored positions without a label row are counted under a null batch.
    The label join, the max window and the per-position sums all use the
    same partitioning on ``pos_key``: one shuffle per input."""
    j = scores.join(labels.select(pos_key, batch, label), pos_key, "full")
    w = Window.partitionBy(pos_key)
    per_pos = (j.withColumn("_mx", F.max(score).over(w))
               .groupBy(pos_key, batch, label)
               .agg(F.first("_mx").alias("_mx"), F.sum(F.exp(F.col(score) - F.col("_mx"))).alias("_se"),
                    F.max(F.when(F.col(item) == F.col(label), F.col(score))).alias("_at")))
    nll = F.col("_mx") + F.log("_se") - F.col("_at")
    used = F.col(label) != F.lit(ignore)
    lost = F.col(batch).isNull() | (used & F.col("_at").isNull())
    return (per_pos.withColumn("_nll", F.when(used, nll)).groupBy(batch)
            .agg(F.count("_nll").alias("n_tokens"), F.avg("_nll").alias("gen_loss"), F.count(F.when(lost, 1)).alias("n_unmatched")))


def linear_logits(vector: Column, weights: list[list[float]], bias: list[float]) -> list[Column]:
    """Logits of a fixed linear probe: one dot product per class, in-row."""
    out = []
    for w, b in zip(weights, bias):
        wl = F.array(*[F.lit(float(x)) for x in w])
        dot = F.aggregate(F.zip_with(vector, wl, lambda x, y: x.cast("double") * y), F.lit(0.0).cast("double"),
                          lambda a, v: a + v)
        out.append(dot + F.lit(float(b)))
    return out


def verification_nll(steps: DataFrame, batch: str, logit0: str, logit1: str, label: str) -> DataFrame:
    """M4: two-class cross-entropy, averaged over **all steps of a batch**."""
    mx = F.greatest(logit0, logit1)
    lse = mx + F.log(F.exp(F.col(logit0) - mx) + F.exp(F.col(logit1) - mx))
    nll = lse - F.when(F.col(label) == 1, F.col(logit1)).otherwise(F.col(logit0))
    return steps.groupBy(batch).agg(F.count(F.lit(1)).alias("n_steps"), F.avg(nll).alias("ver_loss"))


def ragged_verification_nll(samples: DataFrame, steps: DataFrame, batch: list[str], sample: str, logit0: str, logit1: str, label: str) -> DataFrame:
    """M4 on samples with 0 to many steps: ``steps`` has a row a step, ``samples`` one a sample.  ``ver_loss`` is the
    mean over **all steps of a batch**, as the training script has it; ``sample_mean``, the mean of the
    samples' own means, is what a loss by sample would be.  A batch without steps has nulls."""
    mx = F.greatest(logit0, logit1)
    nll = mx + F.log(F.exp(F.col(logit0) - mx) + F.exp(F.col(logit1) - mx)) - F.when(F.col(label) == 1, F.col(logit1)).otherwise(F.col(logit0))
    own = steps.groupBy(*batch, sample).agg(F.count(F.lit(1)).alias("_n"), F.sum(nll).alias("_s"))
    return (samples.select(*batch, sample).join(own, [*batch, sample], "left").groupBy(*batch)
            .agg(F.count(F.lit(1)).alias("n_samples"), F.count("_n").alias("n_with_steps"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_steps"),
                 (F.sum("_s") / F.sum("_n")).alias("ver_loss"), F.avg(F.col("_s") / F.col("_n")).alias("sample_mean")))


def combined_loss(gen: DataFrame, ver: DataFrame, batch: str) -> DataFrame:
    """M5: generation + verification loss per batch; a missing (or null)
    term is simply absent."""
    j = gen.filter(F.col(batch).isNotNull()).select(batch, "gen_loss").join(ver.select(batch, "ver_loss"), batch, "full")
    total = (F.when(F.col("gen_loss").isNull(), F.col("ver_loss"))
             .when(F.col("ver_loss").isNull(), F.col("gen_loss"))
             .otherwise(F.col("gen_loss") + F.col("ver_loss")))
    return j.withColumn("total_loss", total)


def top_k_softmax(scores: DataFrame, grp: str, k: int | None, temperature: float, item: str = "item",
                  score: str = "score") -> DataFrame:
    """M6: scores / temperature, keep those >= the k-th largest (ties kept,
    k capped at the group size; None keeps all), softmax over the kept ones.
    Temperature 0 is the greedy choice (M7) with probability 1."""
    if temperature == 0:
        return argmax(scores, grp, item, score).withColumn("prob", F.lit(1.0))
    s = F.col(score) / F.lit(float(temperature))
    full = Window.partitionBy(grp).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding,
                                                                           Window.unboundedFollowing)
    g = Window.partitionBy(grp)
    x = (scores.withColumn("_s", s)
         .withColumn("_kth", F.min("_s").over(g) if k is None else F.coalesce(F.nth_value("_s", k).over(full), F.min("_s").over(g)))
         .filter(F.col("_s") >= F.col("_kth"))
         .withColumn("_mx", F.max("_s").over(g))
         .withColumn("_e", F.exp(F.col("_s") - F.col("_mx"))))
    return x.withColumn("prob", F.col("_e") / F.sum("_e").over(g)).drop("_s", "_kth", "_mx", "_e")


def argmax(scores: DataFrame, grp: str, item: str = "item", score: str = "score") -> DataFrame:
    """M7: the best item per group; ties go to the lowest item id."""
    best = F.max(F.struct(F.col(score), (-F.col(item)).alias("_neg")))
    return scores.groupBy(grp).agg(best.alias("_b")).select(
        grp, (-F.col("_b._neg")).alias(item), F.col("_b").getField(score).alias(score))


def sample_categorical(probs: DataFrame, grp: str, seed: int, item: str = "item", prob: str = "prob") -> DataFrame:
    """M8: one item per group drawn by probability with a seeded uniform:
    the first item (by id) whose running probability exceeds u; if rounding
    leaves every running sum <= u, the last item with p > 0."""
    w = Window.partitionBy(grp).orderBy(item).rowsBetween(Window.unboundedPreceding, 0)
    x = probs.withColumn("_cum", F.sum(prob).over(w)).withColumn("_u", seeded_uniform(seed, grp))
    return x.groupBy(grp).agg(F.coalesce(F.min(F.when(F.col("_cum") > F.col("_u"), F.col(item))),
                                         F.max(F.when(F.col(prob) > 0, F.col(item)))).alias(item))


def race_categorical(probs: DataFrame, grp: str, seed: int, item: str = "item", prob: str = "prob") -> DataFrame:
    """M8 in one partial aggregate: every item runs to ``-ln(u) / p`` with its own seeded uniform u, and the first one
    home is drawn with probability p (an exponential race).  No order within the group is needed, so a group of
    any size is reduced in the tasks that hold it.  Items without probability don't run; equal times go to the
    smallest item."""
    time = -F.log(seeded_uniform(seed, grp, item)) / F.col(prob)
    return probs.filter(F.col(prob) > 0).groupBy(grp).agg(F.min(F.struct(time.alias("t"), F.col(item).alias("i")))["i"].alias(item))


def truncate_at_stop(tokens: Column, eos: Column, max_new: int) -> Column:
    """M9: generated tokens up to (not including) the first EOS, at most
    ``max_new - 1`` of them."""
    p = F.array_position(tokens, eos)
    stop = F.when(p > 0, p - 1).otherwise(F.size(tokens))
    return F.slice(tokens, 1, F.least(stop, F.lit(max_new - 1)).cast("int"))


def best_checkpoint(metrics: DataFrame, run: str = "run_id", step: str = "step", loss: str = "eval_loss") -> DataFrame:
    """Per run the step with the lowest loss; ties go to the earliest."""
    best = F.min(F.struct(F.col(loss), F.col(step)))
    return metrics.groupBy(run).agg(best.alias("_b")).select(
        run, F.col("_b").getField(step).alias("best_step"), F.col("_b").getField(loss).alias("best_loss"))


def retained_checkpoints(metrics: DataFrame, keep: int, track_best: bool = True, run: str = "run_id", step: str = "step",
                         loss: str = "eval_loss") -> DataFrame:
    """Checkpoints left after rotation with ``keep`` saves.

    Without best-model tracking (stages 1 and 2) the newest ``keep`` survive.
    With it (stage 3) the best one survives plus the newest ``keep - 1``
    others; with ``keep = 1`` a best that is not the newest keeps the newest
    too.  One ranked pass: the rank limit is applied in each task before the
    shuffle, so a long run's rows don't meet in one task."""
    newest = Window.partitionBy(run).orderBy(F.col(step).desc())
    top = metrics.select(run, step).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= keep).drop("_r")
    if not track_best:
        return top.withColumn("is_best", F.lit(0))
    best = best_checkpoint(metrics, run, step, loss).select(run, "best_step")
    others = top.join(best, run).filter(F.col(step) != F.col("best_step"))  # at most ``keep`` rows a run
    others = others.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= max(1, keep - 1))
    return (others.select(run, step, F.lit(0).alias("is_best"))
            .unionByName(best.select(run, F.col("best_step").alias(step), F.lit(1).alias("is_best"))))
