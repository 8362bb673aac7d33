"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's words, lower-cased, give character n-grams of one to four characters with marks at the word's ends; each is hashed to a
bucket that has a short vector. The mean of a text's vectors goes through a linear softmax. Vectors and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled texts; part of it is held back to set the softmax's
temperature and the score under which an answer is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldtrust.llm.common import fold, short_batches, table

FOLDS, HELD = 3, 1
#: Labelled texts that are learned from, shared evenly among the languages: those whose hashed ids come first.
SAMPLE = 6000
BUCKETS, WIDTH, LENGTHS = 1 << 13, 16, (1, 2, 3, 4)
#: Share of right answers that the rejection may give up.
REJECTED = 0.01
UNKNOWN = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters as one blank, blanks at both ends."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, place = np.unique(raw, return_inverse=True)
    known = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
    points = np.concatenate([[32], np.where(known[place], raw, 32), [32]]).astype(np.uint64) if len(raw) else np.full(1, 32, np.uint64)
    return points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]


def subwords(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is hit by the n-grams of the text's words; nothing for a text without a letter."""
    points = letters(text)
    blank = points == 32
    out = np.zeros(buckets, np.int64)
    if blank.all():
        return out
    code = np.zeros(len(points), np.uint64)
    inner = np.zeros(len(points), bool)  # whether a blank lies inside of the n-gram that begins here
    for n in range(1, max(LENGTHS) + 1):
        m = len(points) - n + 1
        if m < 1:
            break
        code = (code[:m] + points[n - 1 :] + np.uint64(n)) * _MIX[0]
        code ^= code >> np.uint64(29)
        inner = inner[:m] | (blank[n - 2 : n - 2 + m] if n > 2 else False)
        if n in LENGTHS:
            real = ~inner if n > 1 else ~blank
            out += np.bincount((((code[real] * _MIX[1]) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return out


@dataclass
class Model:
    """``table`` folds vectors and softmax into one row of logits for each bucket."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return (counts @ self.table / np.maximum(1, counts.sum(axis=-1, keepdims=True)) + self.bias) / self.temperature


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature with the least log loss, and the score that all but ``REJECTED`` of the right answers reach; (1, 0) without rows.

    The targets keep back 1 / (rows + 2) for the other languages: where no row is wrong, scores are not driven to 1.
    """
    if not len(y):
        return 1.0, 0.0
    rows, k = np.arange(len(y)), logits.shape[1]
    back = 1 / (len(y) + 2) if k > 1 else 0.0
    target = np.full(logits.shape, back / max(1, k - 1))
    target[rows, y] = 1 - back
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    t = float(grid[int(np.argmin([-(target * np.log(np.maximum(softmax(logits / t), 1e-300))).sum() for t in grid]))])
    p = softmax(logits / t)
    right = p[rows, y][p.argmax(axis=1) == y]
    return t, float(np.quantile(right, REJECTED)) if len(right) else 0.0


def dense(texts: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> np.ndarray:
    """Rows of shares of the buckets from (buckets hit, how often)."""
    out = np.zeros((len(texts), buckets), np.float32)
    for row, (at, n) in zip(out, texts, strict=True):
        row[at] = n / max(1, n.sum())
    return out


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], calibration: np.ndarray, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = 12, batch: int = 32, rate: float = 40.0, seed: int = 12) -> Model:
    """SGD over ``texts`` (buckets hit, how often), ``y`` the index of the language, ``calibration`` true for rows held back. Languages weigh alike."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (width, k)).astype(np.float32), np.zeros(k, np.float32)
    rows = np.flatnonzero(~calibration)
    weight = (len(rows) / k / np.maximum(1, np.bincount(y[rows], minlength=k)))[y].astype(np.float32)
    steps, done = max(1, epochs * -(-len(rows) // batch)), 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), batch):
            r = rows[at : at + batch]
            x = dense([texts[i] for i in r], buckets)
            hit = np.flatnonzero(x.any(axis=0))
            x = x[:, hit]
            h = x @ vectors[hit]
            g = softmax(h @ out + bias)
            g[np.arange(len(r)), y[r]] -= 1
            g *= weight[r][:, None] / len(r)
            step = rate * (1 - done / steps)
            back = x.T @ (g @ out.T)
            out -= step * 0.05 * (h.T @ g)
            bias -= step * 0.001 * g.sum(axis=0)
            vectors[hit] -= step * back
            done += 1
    folded = vectors @ out
    held = np.flatnonzero(calibration)
    logits = [dense([texts[i] for i in held[at : at + batch]], buckets) @ folded + bias for at in range(0, len(held), batch)]
    t, reject = calibrate(np.concatenate(logits), y[held]) if logits else (1.0, 0.0)
    return Model(langs, folded.astype(np.float64), bias.astype(np.float64), t, reject)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` texts of ``docs(doc_id, text, lang)`` outside of the held-out fold, in equal shares for each language.

    Texts without a letter and rows without a language or an id are left out; a fifth of the sample, by another hash, is kept for
    calibration. None where nothing is left.
    """
    short_batches(docs.sparkSession)
    f = fold(F.col("doc_id"), FOLDS)
    known = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & (f >= 0) & (f != HELD)).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not sizes:
        return None
    share, rank = max(1, sample // len(sizes)), F.xxhash64("doc_id", F.lit(5))
    # a threshold on the hash takes about twice the share of each language, so that few rows are ranked
    odds = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (2 * share + 50) / n))])[F.col("lang")]
    part = known.where(F.pmod(rank, F.lit(1 << 40)) < odds * F.lit(1 << 40)).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(rank, "doc_id")
    picked = part.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= share).drop("_r")
    picked = known.join(F.broadcast(picked), ["doc_id", "lang"])  # at most `sample` ids
    picked = picked.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [subwords(t) for t in b.column(2).to_pylist()]
            at = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([c[a].astype("<i4").tobytes() for c, a in zip(found, at, strict=True)], pa.binary())], ["doc_id", "lang", "at", "n"])

    kinds = T.StructType([picked.schema["doc_id"], picked.schema["lang"], T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])
    rows = [r for r in picked.select("doc_id", "lang", "text").mapInArrow(run, kinds).orderBy("doc_id", "lang").collect() if len(r["at"])]
    if not rows:
        return None
    langs = sorted({r.lang for r in rows})
    texts = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in rows]
    y = np.array([langs.index(r.lang) for r in rows])
    calibration = np.arange(len(rows)) % 5 == 0 if len(rows) >= 20 * len(langs) else np.zeros(len(rows), bool)
    return fit(texts, y, langs, calibration)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the calibrated probability), ``accepted`` and ``held_out``; columns of these names are replaced.

    The whole text counts. Null texts and texts without a letter, and all texts without a model, are ``und`` with score 0 and not
    accepted. Of equal logits the language that sorts first is taken.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, sure = [], [], []
            for t in b.column(b.schema.get_field_index("text")).to_pylist():
                c = subwords(t)
                if model is None or not c.any():
                    langs.append(UNKNOWN), scores.append(0.0), sure.append(False)
                    continue
                hit = np.flatnonzero(c)
                p = softmax((c[hit] @ model.table[hit] / c.sum() + model.bias) / model.temperature)
                best = int(p.argmax())
                langs.append(model.langs[best]), scores.append(float(p[best])), sure.append(bool(p[best] >= model.reject))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], [*b.schema.names, "lang_pred", "score", "accepted"])

    base = docs.drop("lang_pred", "score", "accepted", "held_out")
    kinds = T.StructType([*base.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return base.mapInArrow(run, kinds).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predicted(docs.select("doc_id", "text"), train(docs)).select("doc_id", "held_out", "lang_pred", "score", "accepted")
