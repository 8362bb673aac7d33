"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of word pairs, words and the uniform law are mixed. The weights depend on how often the context
was seen (buckets of its count) and are learned by expectation-maximisation on held-out counts: for the texts of one training
fold every count is taken without the text's own share. Counts are gathered over all training texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm import chunks as ch
from fieldtrust.llm.common import release, written

FOLDS, HELD_OUT, TUNED = 7, 2, 0
SEED = 9
END = xxhash.xxh64_intdigest(b"", SEED)
BUCKETS = 24
STEPS_PER_DECADE = 12
NONE = -999
CACHE = 600_000
LONG = 64


def fold_of(doc_id: int | None) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONG:  # so the memory is bounded in bytes too
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


class _Tokens:
    """The words and word pairs of a chunk as keys: ``words`` and ``pairs`` distinct and sorted, ``w`` and ``p`` their places by token."""

    def __init__(self, sizes: np.ndarray, data: bytes):
        raw, hashes, parts, at = ch.unsqueeze(data), _Hashes(), [], 0
        self.lengths = np.empty(len(sizes), np.int64)
        for i, n in enumerate(sizes):
            words = raw[at : at + n].lower().split()
            at += n
            words_keys = np.empty(len(words) + 1, np.uint64)
            words_keys[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            words_keys[-1] = END
            parts.append(words_keys)
            self.lengths[i] = len(words_keys)
        keys = np.concatenate(parts)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(sizes)), self.lengths)
        before = np.empty_like(keys)
        before[1:] = keys[:-1]
        before[self.starts] = np.uint64(END)  # the end of a text stands before the next
        pairs = before * np.uint64(0x9E3779B97F4A7C15) + keys
        pairs ^= pairs >> np.uint64(31)
        pairs *= np.uint64(0xD6E8FEB86659FD93)
        pairs ^= pairs >> np.uint64(29)
        self.words, self.w = np.unique(keys, return_inverse=True)
        self.pairs, self.p = np.unique(pairs, return_inverse=True)


def _asked(chunks: DataFrame, ranges: int) -> DataFrame:
    """Rows (chunk, range, keys, counts): the distinct keys of a chunk with their counts in its training texts; words in the first ``ranges`` ranges, pairs in the next."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                t = _Tokens(np.asarray(r.sizes), r.data)
                train = np.array([fold_of(i) != HELD_OUT for i in ch.ids_of(r)])[t.doc]
                for base, keys, place in ((0, t.words, t.w), (ranges, t.pairs, t.p)):
                    n = np.bincount(place[train], minlength=len(keys)).astype(np.uint64)
                    out = [(r.chunk, base + k, ch.put_sorted(keys[a:b]), ch.put(n[a:b])) for k, a, b in ch.runs(keys, ranges)]
                    yield pd.DataFrame(out, columns=["chunk", "range", "keys", "counts"])

    return chunks.select("chunk", "ids", "known", "sizes", "data").mapInPandas(run, "chunk long, range long, keys binary, counts binary")


def _answered(asked: DataFrame, ranges: int) -> DataFrame:
    """Rows (chunk, range, counts): the corpus counts of the keys asked; chunk -1 has a word range's number of ``types`` and ``tokens``."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [ch.got_sorted(k) for k in pdf["keys"]]
        counts = np.concatenate([ch.got(c) for c in pdf["counts"]])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        out = [(c, key[0], ch.put(total[place[e - len(k) : e]]), 0, 0) for c, k, e in zip(pdf["chunk"], keys, ends, strict=True)]
        if key[0] < ranges:
            out.append((-1, key[0], None, int((total > 0).sum()), int(total.sum())))
        return pd.DataFrame(out, columns=["chunk", "range", "counts", "types", "tokens"])

    return asked.groupBy("range").applyInPandas(run, "chunk long, range long, counts binary, types long, tokens long")


class _Counted(_Tokens):
    """A chunk's tokens with the corpus counts of each: its pair, its word and its context."""

    def __init__(self, row, answers: pd.DataFrame, ranges: int):
        super().__init__(np.asarray(row.sizes), row.data)
        answers = answers.sort_values("range")
        whole = lambda rows: np.concatenate([ch.got(x) for x in rows["counts"]]).astype(np.int64)
        words = whole(answers[answers["range"] < ranges])
        self.c1 = words[self.w]
        self.c2 = whole(answers[answers["range"] >= ranges])[self.p]
        self.ends = int(words[np.searchsorted(self.words, np.uint64(END))])
        self.ctx = np.empty_like(self.c1)
        self.ctx[1:] = self.c1[:-1]
        self.ctx[self.starts] = self.ends


def _bucket(ctx: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(ctx + 1.0)).astype(np.int64), BUCKETS - 1)


def _step(f: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.rint(np.log10(np.where(f > 0, f, 1)) * STEPS_PER_DECADE), NONE).astype(np.int64)


def _held_out_counts(chunks: DataFrame, answers: DataFrame, ranges: int, n: int) -> DataFrame:
    """How many tokens of the tuned fold have which context bucket, pair estimate and word estimate (in steps of a twelfth of a decade), each without its text's own counts."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cells: dict = {}
        for row in left.itertuples(index=False):
            t = _Counted(row, right, ranges)
            docs = np.flatnonzero([fold_of(i) == TUNED for i in ch.ids_of(row)])
            for d in docs:
                s = slice(t.starts[d], t.starts[d] + t.lengths[d])
                _, w, own_w = np.unique(t.w[s], return_inverse=True, return_counts=True)
                _, p, own_p = np.unique(t.p[s], return_inverse=True, return_counts=True)
                own_ctx = np.concatenate([[1], own_w[w][:-1]])
                ctx = t.ctx[s] - own_ctx
                f2 = np.where(ctx > 0, (t.c2[s] - own_p[p]) / np.maximum(ctx, 1), 0.0)
                f1 = (t.c1[s] - own_w[w]) / max(1, n - int(t.lengths[d]))
                code = (_bucket(ctx) * 4096 + _step(f2) + 1024) * 4096 + _step(f1) + 1024
                for k, v in zip(*np.unique(code, return_counts=True), strict=True):
                    cells[int(k)] = cells.get(int(k), 0) + int(v)
        return pd.DataFrame({"cell": list(cells), "n": list(cells.values())}, dtype="int64")

    cols = chunks.select("chunk", "ids", "known", "sizes", "data").groupBy("chunk")
    return cols.cogroup(answers.groupBy("chunk")).applyInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learn_weights(cells: list[tuple[int, int]], uniform: float, rounds: int = 300) -> np.ndarray:
    """Weights (bucket; pair, word, uniform) that make the held-out counts likeliest, by expectation-maximisation from equal parts.

    Buckets without held-out tokens take the weights of the nearest one below, or equal parts; the bucket of unseen
    contexts has no pair estimate and so no weight on it.
    """
    code = np.array([c for c, _ in cells], np.int64)
    n = np.array([x for _, x in cells], np.float64)
    value = lambda s: np.where(s == NONE, 0.0, 10.0 ** (s / STEPS_PER_DECADE))
    bucket = code // (4096 * 4096)
    f = np.stack([value(code // 4096 % 4096 - 1024), value(code % 4096 - 1024), np.full(len(code), uniform)], axis=1) if len(code) else np.empty((0, 3))
    out = np.full((BUCKETS, 3), np.nan)
    for b in range(BUCKETS):
        at = bucket == b
        if not at.any():
            continue
        lam, g, m = np.full(3, 1 / 3), f[at], n[at]
        for _ in range(rounds):
            share = lam * g
            new = (m[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / m.sum()
            done = np.abs(new - lam).max() < 1e-7
            lam = new
            if done:
                break
        lam = np.maximum(lam, [0.0, 1e-6, 1e-6])
        out[b] = lam / lam.sum()
    last = np.array([0.0, 0.5, 0.5])
    for b in range(BUCKETS):
        if np.isnan(out[b, 0]):
            out[b] = last
        last = out[b]
    out[0] = [0.0, out[0, 1] / (out[0, 1] + out[0, 2]), out[0, 2] / (out[0, 1] + out[0, 2])]
    return out


def mixture(weights: np.ndarray, ctx: np.ndarray, pair: np.ndarray, word: np.ndarray, n: int, types: int) -> np.ndarray:
    """Probabilities from the counts of the context, of the pair and of the word."""
    lam = weights[_bucket(ctx)]
    return lam[:, 0] * (pair / np.maximum(ctx, 1)) + lam[:, 1] * (word / max(n, 1)) + lam[:, 2] / (types + 1)


def scores(docs: DataFrame, learned: list | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row for each input row.

    ``learned``, where given, receives the learned weights (bucket; pair, word, uniform). Repeated rows count as often as
    they occur; columns other than the two are not looked at; an empty table gives no rows.

    Texts of fold 2 (crc32 of the id, modulo 7) are not learned from; null ids are learned from. A null or empty text is
    its end token. Where nothing was learned the uniform law over one type is left, which gives every token probability 1.
    """
    packed = ch.pack(docs, "lm-chunks")
    ranges = ch.ranges_for(packed)
    spark = docs.sparkSession
    answers = written(_answered(_asked(packed, ranges), ranges), "lm-counts")
    release(spark)
    types, n = answers.where("chunk = -1").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    answers = answers.where("chunk >= 0").select("chunk", "range", "counts")
    cells = _held_out_counts(packed, answers, ranges, n).collect()  # at most buckets * steps * steps rows
    release(spark)
    weights = learn_weights([(r["cell"], r["n"]) for r in sorted(cells)], 1 / (types + 1))
    if learned is not None:
        learned.append(weights)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples(index=False):
            t = _Counted(row, right, ranges)
            p = mixture(weights, t.ctx, t.c2, t.c1, n, types)
            add = lambda x, t=t: np.add.reduceat(x, t.starts)
            ids = ch.ids_of(row)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(ids, "Int64"),
                        "held_out": [fold_of(i) == HELD_OUT for i in ids],
                        "n_tokens": t.lengths,
                        "n_known": add((t.c1 > 0).astype(np.int64)),
                        "train_tokens": n,
                        "base_score": add(np.log10((t.c1 + 1) / (n + types + 1))),
                        "score": add(np.log10(p)),
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.select("chunk", "ids", "known", "sizes", "data").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
