"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled texts train a small network on features of the whole text. The risk is the
unbiased one, pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)), up to a small slack. The class prior pi is estimated from positives and
unlabelled texts alone; labelled negatives are used nowhere. The hidden layer, which only makes features, is fitted on bounded
samples; the output layer minimises the risk over all unlabelled texts of the training folds, by Newton steps whose sums are taken
where the texts are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrust.llm.common import fold, short_batches, written

FOLDS = 5
SAMPLE = 6000
THRESHOLD = 0.3
#: How far the negative part of the risk may fall below zero, as a share of R-(positives): about what the estimate of the prior is off by.
SLACK = 0.03
MARK = re.compile(rb"[^\x00-\x20\x30-\x39A-Za-z\x80-\xff]{2,}")
# what each shape feature counts over the words or bytes of a text
SHAPES = ("words", "distinct", "top", "pairs", "long", "mean", "caps", "marked", "ends", "bars", "digits", "lines", "dup_lines", "symbols", "upper", "letters", "runs", "short")


def features(text: str | None) -> np.ndarray:
    """Shape counts as shares, then the byte histogram in roots of shares; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    m = max(1, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower, digits = hist[65:91].sum(), hist[97:123].sum() + hist[128:].sum(), hist[48:58].sum()
    symbols = size - upper - lower - digits - hist[9:14].sum() - hist[32] - hist[[44, 46]].sum()
    marks = MARK.findall(raw)
    caps = sum(1 for w in words[:] if len(w) > 1 and w.isupper())
    long_words = sum(1 for w in words if len(w) > 25)
    short = sum(1 for w in words if len(w) <= 2)
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
    x = np.array(
        [
            math.log1p(n), len(counts) / m, max(counts.values(), default=0) / m, pairs / max(1, n - 1), long_words / m, min(1.0, (size / m) / 20),
            caps / m, min(1.0, len(marks) / m), sum(1 for w in words if w[-1:] in b".,;:!?") / m, raw.count(b"|") / m, digits / size, len(lines) / m,
            1 - len(set(lines)) / max(1, len(lines)), max(0.0, symbols) / size, upper / size, lower / size, sum(map(len, marks)) / size, short / m,
        ]
    )
    return np.concatenate([x, np.sqrt(hist / size)]).astype(np.float32)


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float

    def hide(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, np.clip((x - self.mean) / self.scale, -8, 8) @ self.hidden + self.bias)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.hide(x) @ self.out + self.out_bias, -30, 30)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, width: int = 24, steps: int = 900, rate: float = 4e-3, decay: float = 1e-4, batch: int = 512, seed: int = 4) -> Classifier:
    """Minimise the non-negative risk by Adam on minibatches; where the negative part falls below zero by more than the slack, step back along it."""
    rng = np.random.default_rng(seed)
    mean = unlabelled.mean(axis=0, dtype=np.float64)
    scale = unlabelled.std(axis=0, dtype=np.float64) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positives, unlabelled))
    d = p.shape[1]
    w = [rng.normal(0, math.sqrt(1.0 / d), (d, width)), np.zeros(width), rng.normal(0, math.sqrt(1.0 / width), width), np.zeros(1)]
    w[3][0] = math.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    m1, m2 = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        a = p[rng.integers(0, len(p), min(batch, len(p)))]
        b = u[rng.integers(0, len(u), min(2 * batch, len(u)))]
        x = np.concatenate([a, b])
        z = x @ w[0] + w[1]
        h = np.maximum(z, 0)
        f = h @ w[2] + w[3][0]
        s = 1.0 / (1.0 + np.exp(-f))
        na, nb = len(a), len(b)
        # logistic loss: d/df of l(f, +1) is s - 1, of l(f, -1) is s
        negative = np.logaddexp(0, f[na:]).mean() - (prior - SLACK) * np.logaddexp(0, f[:na]).mean()
        g = np.empty(len(x))
        if negative >= 0:
            g[:na] = prior * (s[:na] - 1) / na - prior * s[:na] / na
            g[na:] = s[na:] / nb
        else:
            g[:na] = prior * s[:na] / na
            g[na:] = -s[na:] / nb
        gz = np.outer(g, w[2]) * (z > 0)
        grads = [x.T @ gz + decay * w[0], gz.sum(axis=0), h.T @ g + decay * w[2], np.array([g.sum()])]
        for k, gk in enumerate(grads):
            m1[k] = 0.9 * m1[k] + 0.1 * gk
            m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
            w[k] = w[k] - rate * (1 - 0.9 * t / steps) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return Classifier(mean, scale, w[0], w[1], w[2], float(w[3][0]), prior)


def _matrix(docs: DataFrame) -> np.ndarray:
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in b.column(0).to_pylist()], pa.binary())], ["x"])

    rows = docs.select("text").mapInArrow(run, "x binary").collect()
    return np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), len(SHAPES) + 256)


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray, steps: int = 8, ridge: float = 1.0) -> float:
    """The share of good texts among the unlabelled, kept off 0 and 1.

    A logistic model tells half of the positives from half of the unlabelled. Above any threshold of its score the other
    halves hold the shares P and U, and U is at least pi * P: the least U / P over the thresholds bounds pi from above and meets
    it where no bad text scores as high.
    """
    mean, scale = unlabelled.mean(axis=0, dtype=np.float64), unlabelled.std(axis=0, dtype=np.float64) + 1e-3
    p, u = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positives, unlabelled))
    x, y = np.vstack([p[::2], u[::2]]), np.concatenate([np.ones(len(p[::2])), np.zeros(len(u[::2]))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (s * (1 - s))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (s - y) + ridge * w)
    sp, su = np.sort((p[1::2] if len(p) > 1 else p) @ w), np.sort((u[1::2] if len(u) > 1 else u) @ w)
    best = 1.0
    for t in np.quantile(sp, np.linspace(0.02, 0.5, 25)):
        a, b = 1 - np.searchsorted(sp, t) / len(sp), 1 - np.searchsorted(su, t) / len(su)
        best = min(best, b / max(a, 1e-9))
    return min(0.99, max(0.01, best))


def _hidden(docs: DataFrame, model: Classifier) -> DataFrame:
    """The hidden layer of all texts, some thousand to a row: 4 * width bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(0).to_pylist()]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([model.hide(x).astype(np.float32).tobytes()], pa.binary())], ["h"])

    return written(docs.select("text").mapInArrow(run, "h binary"), "quality-hidden")


def refine(hidden: DataFrame, positives: np.ndarray, model: Classifier, steps: int = 6, ridge: float = 0.3) -> Classifier:
    """The output layer that minimises the risk over all of ``hidden``, held near the one given by ``ridge``.

    With the logistic loss the unbiased risk is -pi * mean(f of positives) + mean(log(1 + exp(f)) of unlabelled), which is
    convex. A step that does not lower it, or would make its negative part, R-(unlabelled) - pi * R-(positives), fall below
    zero, is halved, and learning ends where no such step is left.
    """
    width = len(model.out)
    p = np.hstack([model.hide(positives), np.ones((len(positives), 1))])
    start = np.append(model.out, model.out_bias)

    def sums(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + len(w) + len(w) ** 2)
            for b in batches:
                for raw in b.column(0).to_pylist():
                    x = np.frombuffer(raw, np.float32).reshape(-1, width).astype(np.float64)
                    x = np.hstack([x, np.ones((len(x), 1))])
                    f = np.clip(x @ w, -30, 30)
                    s = 1 / (1 + np.exp(-f))
                    total += np.concatenate([[len(x), np.logaddexp(0, f).sum()], s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

        rows = hidden.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # a number for each entry
        v = np.zeros(2 + len(w) + len(w) ** 2)
        for r in rows:
            v[r.k] = r.v
        n = max(v[0], 1.0)
        return v[0], v[1] / n, v[2 : 2 + len(w)] / n, v[2 + len(w) :].reshape(len(w), len(w)) / n

    def negative(loss: float, w: np.ndarray) -> float:
        return loss - (model.prior - SLACK) * np.logaddexp(0, np.clip(p @ w, -30, 30)).mean()

    def risk(loss: float, w: np.ndarray) -> float:
        return loss - model.prior * (p @ w).mean() + ridge / 2 * ((w - start) ** 2).sum()

    w = start
    n, loss, slope, bend = sums(w)
    if not n or negative(loss, w) < 0:
        return model
    for _ in range(steps):
        g = slope - model.prior * p.mean(axis=0) + ridge * (w - start)
        move = np.linalg.solve(bend + ridge * np.eye(len(w)), g)
        for k in range(5):
            tried = w - move * 0.5**k
            now = sums(tried)
            if negative(now[1], tried) >= 0 and risk(now[1], tried) < risk(loss, w):
                break
        else:
            break
        w, (_, loss, slope, bend) = tried, now
        if np.abs(move).max() < 1e-4:
            break
    return replace(model, out=w[:-1], out_bias=float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Fit on at most ``sample`` trusted positives, those whose hashed ids come first, and all unlabelled texts.

    The hidden layer is fitted on the positives and on at most ``sample`` unlabelled texts; the output layer on all. Rows of
    fold 0 are never used. An id that repeats gives one text to the samples. None where there is no positive or no
    unlabelled text.
    """
    known = labels.where(fold(F.col("doc_id"), FOLDS) > 0)
    rank = F.xxhash64("doc_id", F.lit(11))
    good = known.where("quality = 1").select("doc_id").distinct().orderBy(rank, "doc_id").limit(sample)
    mine = docs.where(fold(F.col("doc_id"), FOLDS) > 0)
    web = mine.select("doc_id").distinct().orderBy(rank, "doc_id").limit(sample)
    ids = good.withColumn("g", F.lit(1)).unionAll(web.withColumn("g", F.lit(0)))
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * sample ids
    picked = picked.groupBy("g", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    x = _matrix(picked.where("g = 1").orderBy("doc_id"))
    u = _matrix(picked.where("g = 0").orderBy("doc_id"))
    if not len(x) or not len(u):
        return None
    model = fit(x, u, estimate_prior(x, u))
    return refine(_hidden(mine, model), x, model)


def scored(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """``docs`` with ``score`` from the whole text, ``predicted`` and ``held_out``; columns of these names are replaced.

    Without a model every score is 0.5. Null and empty texts get the model's score of the empty text.
    """

    short_batches(docs.sparkSession)

    def run(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts:
            at = b.schema.get_field_index("text")
            t = b.column(at).to_pylist()
            s = model.score(np.array([features(x) for x in t]).reshape(len(t), -1)) if model and t else np.full(len(t), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    base = docs.drop("score", "predicted", "held_out")
    kinds = T.StructType([*base.schema, T.StructField("score", T.DoubleType())])
    return base.mapInArrow(run, kinds).withColumns({"predicted": (F.col("score") >= THRESHOLD).cast("int"), "held_out": fold(F.col("doc_id"), FOLDS) == 0})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return scored(docs, train(docs, labels)).select("doc_id", "held_out", "score", "predicted")
