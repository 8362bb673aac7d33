"""Fingerprints within k bits, found under the keys of ``dedup.slice_masks`` within tasks that give sums and forests, never the pairs.

Near pairs grow with the square of the rows. Here rows are dealt by key (three slices and their value) and sorted by it; a task
takes whole keys, compares the fingerprints of a key with those so many places further on, all keys at once, and only counts by
row or links that join something leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task takes at once (more where one key has more), and pairs or look-ups of one step.
ROWS, STEP = 1 << 16, 1 << 20


def dealt(rows: DataFrame, masks: list[int], *columns: str) -> DataFrame:
    """``(choice, value, fp, *columns)`` of every row under every key, in parts that hold whole keys, sorted by key and fingerprint.

    The number of parts is fixed: the work of a part is that of its pairs, which its bytes do not tell.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(masks)])
    keyed = rows.select("fp", *columns, F.explode(keys).alias("key")).select("key.choice", "key.value", "fp", *columns)
    return keyed.repartition(parts, "choice", "value").sortWithinPartitions("choice", "value", "fp")


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of at least ``ROWS`` (but for the last), none of which ends within a key."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, ROWS
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n < enough:
            continue
        t = pa.Table.from_batches(held)
        ends = key_ends(t)
        cut = int(ends[-2]) if len(ends) > 1 else 0  # the last key may go on
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            n -= cut
        enough = max(ROWS, 2 * n)
    if held:
        yield pa.Table.from_batches(held)


def key_ends(t: pa.Table) -> np.ndarray:
    """Where each key's rows end."""
    choice, value = t.column("choice").to_numpy(), t.column("value").to_numpy()
    return np.append(np.flatnonzero((choice[1:] != choice[:-1]) | (value[1:] != value[:-1])) + 1, len(choice))


def near(fp: np.ndarray, ends: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places ``(i, j, distance)``, i < j, of a key's different fingerprints within k bits, some at a time."""
    fp = fp.view(np.uint64)  # the bits of a negative number are not counted as they stand
    last = np.repeat(ends, np.diff(ends, prepend=0))
    at = np.arange(len(fp))
    lag, some, n = 1, [], 0
    while True:
        at = at[at + lag < last[at]]
        if not len(at):
            break
        d = np.bitwise_count(fp[at] ^ fp[at + lag])
        hit = (d <= k) & (d > 0)
        if hit.any():
            i = at[hit]
            some.append((i, i + lag, d[hit].astype(np.int64)))
            n += len(i)
            if n >= STEP:
                yield tuple(np.concatenate(x) for x in zip(*some, strict=True))
                some, n = [], 0
        lag += 1
    if some:
        yield tuple(np.concatenate(x) for x in zip(*some, strict=True))


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least place that each of ``n`` reaches over the pairs."""
    root = np.arange(n)
    for i, j, _ in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def forest(fps: DataFrame, masks: list[int], k: int) -> DataFrame:
    """Distinct ``fp`` to links ``(a, b)`` that join what near pairs join: of a key's rows each to the least one it reaches, so at most a row for each fingerprint and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches):
            fp = t.column("fp").to_numpy()
            root = roots(len(fp), near(fp, key_ends(t), k))
            moved = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["a", "b"])

    return dealt(fps.select("fp"), masks).mapInArrow(run, "a long, b long")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def earlier_counts(rows: DataFrame, masks: list[int], k: int) -> DataFrame:
    """``rows(fp, asks, seqs)``, seqs sorted, to ``(seq, n, d)``: for the seqs of rows that ask how many smaller seqs rows of other, near fingerprints have, and the least distance among those.

    Of a seq there is a row for each of its keys under which something was found; counts add up, as each pair counts under the first
    key that it agrees on. Earlier seqs are counted by looking a seq up among the sorted ones of the other row.
    """
    bits = np.array([m & (2**64 - 1) for m in masks], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches):
            t = t.combine_chunks()
            fp, choice = t.column("fp").to_numpy(), t.column("choice").to_numpy()
            ends = key_ends(t)
            asks = t.column("asks").to_numpy()
            lists = t.column("seqs").chunk(0)
            size = lists.value_lengths().to_numpy().astype(np.int64)
            starts = np.cumsum(size) - size
            seqs = lists.flatten().to_numpy()
            distinct, rank = np.unique(seqs, return_inverse=True)
            placed = np.repeat(np.arange(len(fp)), size) * (len(distinct) + 1) + rank  # rises throughout
            n, least = np.zeros(len(seqs), np.int64), np.full(len(seqs), 64, np.int64)
            for i, j, d in near(fp, ends, k):
                x = (fp[i] ^ fp[j]).view(np.uint64)
                under = choice[i]
                first = np.ones(len(i), bool)
                for c in range(int(under.max())):
                    first &= ((x & bits[c]) != 0) | (under <= c)
                i, j, d = i[first], j[first], d[first]
                for one, other in ((i, j), (j, i)):
                    asked = asks[one]
                    a, b, e = one[asked], other[asked], d[asked]
                    if not len(a):
                        continue
                    # so many look-ups at once; a row by itself has no more than a block's
                    cuts = np.searchsorted(np.cumsum(size[a]), np.arange(STEP, int(size[a].sum()) + STEP, STEP))
                    for lo, hi in zip(np.append(0, cuts[:-1] + 1), np.minimum(cuts + 1, len(a)), strict=True):
                        if lo >= hi:
                            continue
                        p, q, f = a[lo:hi], b[lo:hi], e[lo:hi]
                        at = ragged(starts[p], size[p])
                        who = np.repeat(np.arange(len(p)), size[p])
                        found = np.searchsorted(placed, q[who] * (len(distinct) + 1) + rank[at]) - starts[q][who]
                        some = found > 0
                        at, found, f = at[some], found[some], f[who[some]]
                        n += np.bincount(at, found, len(n)).astype(np.int64)
                        np.minimum.at(least, at, f)
            told = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(seqs[told]), pa.array(n[told]), pa.array(least[told].astype(np.int32))], ["seq", "n", "d"])

    return dealt(rows, masks, "asks", "seqs").mapInArrow(run, "seq long, n long, d int")
