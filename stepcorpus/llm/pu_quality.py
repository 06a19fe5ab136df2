"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good; every other text is unlabelled, whatever
its label.  A linear scorer over shape features of the whole text minimises
the non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the logistic loss, by Newton steps on a bounded sample
(``FIT_POSITIVE`` and ``FIT_UNLABELLED`` rows, those with the smallest hashes
of their doc_id).  The class prior is estimated over all rows: a first
scorer, fitted with an even prior, ranks positives and unlabelled rows; the
prior is the smallest ratio of their shares above a threshold, with a
deviation bound for each share.

Labels are learned only from rows outside the held-out fold.  Null and empty
texts have all-zero shape features and get that score.  Rows that repeat a
doc_id are scored one by one; repeated label rows count once; null label
ids match nothing.  Without a positive every text scores 0.5.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepcorpus.llm.arrowtext import as_bytes, slices, spans_of, word_hashes, words
from stepcorpus.session import materialize

FOLDS = 5  # crc32(doc_id) mod FOLDS = 0 is held out
FIT_POSITIVE = 20_000
FIT_UNLABELLED = 40_000
STEPS = 30
RIDGE = 1e-4
BINS = 1000  # of the first scores, for the prior
CERTAINTY = 0.1  # chance that the prior's deviation bounds fail
ACCEPT = 0.3

_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:", "!?", "#*$%&|<>@^~=+/\\_", "\"'`()[]{}-"]
KIND = np.full(256, len(_KINDS) + 1, np.uint8)  # other control bytes
KIND[128:] = len(_KINDS)
for _i, _chars in enumerate(_KINDS):
    KIND[[ord(c) for c in _chars]] = _i
N_KINDS = len(_KINDS) + 2
N_FEATURES = N_KINDS * N_KINDS + 5


def held_out(key: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def shape_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text: square roots of the shares of pairs of byte kinds; length; word length; how varied and how repeated its words are."""
    n = len(at) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    size = np.diff(at)
    if len(data) > 1:
        kinds = KIND[data].astype(np.int64)
        pair = kinds[:-1] * N_KINDS + kinds[1:]
        doc = np.repeat(np.arange(n), size)
        same = doc[:-1] == doc[1:]
        pairs = np.bincount((doc[:-1] * (N_KINDS * N_KINDS) + pair)[same], minlength=n * N_KINDS * N_KINDS).reshape(n, -1)
        out[:, :N_KINDS * N_KINDS] = np.sqrt(pairs / np.maximum(size - 1, 1)[:, None])
    starts, ends, first = words(data, at)
    n_words = np.diff(first)
    if len(starts):
        hashes = word_hashes(data, starts, ends)
        doc = np.repeat(np.arange(n), n_words)
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((hashes, doc))
        new = np.ones(len(starts), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        share = lambda x: np.bincount(doc, weights=x, minlength=n) / np.maximum(n_words, 1)
        out[:, -4] = share((ends - starts).astype(float)) / 10
        out[:, -3] = share(again)
        out[:, -2] = share(new[np.argsort(order)])
        run_lo, run_hi = spans_of(again)
        out[:, -1] = np.bincount(doc[run_lo], weights=np.minimum(run_hi - run_lo, 10), minlength=n) / np.maximum(n_words, 1)
    out[:, -5] = np.log1p(n_words) / 10
    return out


def features(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, positive (trusted, outside the held-out fold) and x, written once."""
    def task(batches):
        for b in batches:
            for lo, hi, data, at in slices(b, "text"):
                x = shape_features(data, at)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(2)), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "held_out", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", held_out(F.col("doc_id"), folds).alias("held_out"))
    x = as_bytes(keyed, "doc_id", "held_out").mapInArrow(task, f"doc_id {kind}, held_out boolean, x binary")
    good = labels.filter("quality = 1").select("doc_id").distinct().withColumn("_good", F.lit(True))
    return materialize(x.join(good, "doc_id", "left").select("doc_id", "held_out", (F.coalesce("_good", F.lit(False)) & ~F.col("held_out")).alias("positive"), "x"), "quality-x")


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """The ``n`` rows of the smallest hashes.  Rows that can't be among them are
    left out before, as each task would send ``n`` rows to the driver."""
    total = rows.count()
    if total > 2 * n:
        low = rows.filter(F.xxhash64("doc_id") < int(2 * n / total * 2**64) - 2**63)  # about 2 n rows
        if low.count() >= n:
            rows = low
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("x").collect()
    x = np.frombuffer(b"".join(bytes(r[0]) for r in got), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    return np.hstack([x, np.ones((len(x), 1))])


def fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the non-negative risk: Newton steps, turned round while the negative part is below 0."""
    w = np.zeros(p.shape[1])
    mean_p, best, best_risk = p.mean(0), w, np.inf
    for _ in range(steps):
        fp, fu = p @ w, u @ w
        up, uu = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))  # derivatives of l(-f)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        risk = prior * np.logaddexp(0, -fp).mean() + max(0.0, negative) + ridge / 2 * w @ w
        if risk < best_risk:
            best, best_risk = w, risk
        curve = (u * (uu * (1 - uu))[:, None]).T @ u / len(u) + max(ridge, 1e-6) * np.eye(len(w))
        if negative >= 0:
            slope = u.T @ uu / len(u) - prior * mean_p + ridge * w
        else:  # raise the negative part back to 0 before anything else
            slope = -(u.T @ uu / len(u) - prior * (p.T @ up) / len(p))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 10.0 / max(1e-9, np.abs(u @ step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return best


def estimate_prior(counts_p: np.ndarray, counts_u: np.ndarray, certainty: float = CERTAINTY) -> float:
    """Smallest bounded ratio of the shares above a threshold: above it nearly all unlabelled rows are positives."""
    n_p, n_u = counts_p.sum(), counts_u.sum()
    q_p, q_u = np.cumsum(counts_p[::-1]) / max(1, n_p), np.cumsum(counts_u[::-1]) / max(1, n_u)
    slack = np.sqrt(np.log(4 / certainty) / 2) * (1 / np.sqrt(max(1, n_u)) + 1 / np.sqrt(max(1, n_p)))
    ok = q_p > 0
    at = int(np.argmin(np.where(ok, (q_u + slack) / np.maximum(q_p, 1e-12), np.inf)))
    return float(np.clip(q_u[at] / max(q_p[at], 1e-12), 0.01, 0.99))


def _scored(x: DataFrame, w: np.ndarray, keep: list[str]) -> DataFrame:
    def task(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                m = np.frombuffer(b"".join(part.column(part.num_columns - 1).to_pylist()), np.float32).reshape(-1, N_FEATURES)
                score = 1 / (1 + np.exp(-np.clip(m @ w[:-1] + w[-1], -50, 50)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score, pa.float64())], [*keep, "score"])

    rows = x.select(*keep, "x")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(task, f"{kinds}, score double")


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    x = features(docs, labels, folds)
    train = x.filter("not held_out")
    p, u = _sample(train.filter("positive"), FIT_POSITIVE), _sample(train, FIT_UNLABELLED)
    if len(p) and len(u):
        first = fit(p, u, 0.5)
        bins = _scored(train, first, ["positive"]).groupBy("positive", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect()
        counts = np.zeros((2, BINS))
        for positive, at, n in bins:  # two rows a bin
            counts[int(positive), at] += n
        w = fit(p, u, estimate_prior(counts[1], counts.sum(0)))
    else:
        w = np.zeros(N_FEATURES + 1)
    return _scored(x, w, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= accept).cast("int"))
