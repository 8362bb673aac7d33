"""Near fingerprints compared within tasks, against brute force; no pairs leave a task."""

import random

import numpy as np
import pytest

from fieldtrust.operators import dedup, slices


def fingerprints(seed=5):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**64, 12, dtype=np.uint64)]
    fps = set(base) | {b ^ sum(1 << int(p) for p in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 4, 5)}
    fps |= {base[0] ^ (1 << p) for p in range(64)} | {0, 1 << 63}
    return sorted(f - 2**64 if f >> 63 else f for f in fps)


def apart(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize(("rows", "step"), [(16, 8), (1 << 16, 1 << 20)])
def test_earlier_seqs_of_near_fingerprints(spark, monkeypatch, rows, step):
    monkeypatch.setattr(slices, "ROWS", rows)
    monkeypatch.setattr(slices, "STEP", step)
    rng, fps = random.Random(3), fingerprints()
    held: dict = {}
    for seq in rng.sample(range(-50, 10_000), 500):
        held.setdefault((rng.choice(fps), rng.random() < 0.8), []).append(seq)
    table = [(f, asks, sorted(s)) for (f, asks), s in held.items()]
    out = slices.earlier_counts(spark.createDataFrame(table, "fp long, asks boolean, seqs array<long>"), dedup.slice_masks(3), 3)
    got: dict = {}
    for r in out.collect():
        n, d = got.get(r.seq, (0, 64))
        got[r.seq] = (n + r.n, min(d, r.d))
    want = {}
    for f, asks, seqs in table:
        for s in seqs if asks else ():
            near = [apart(f, g) for g, _, others in table for o in others if o < s and 0 < apart(f, g) <= 3]
            if near:
                want[s] = (len(near), min(near))
    assert got == want


def test_one_key_that_all_rows_have(spark, monkeypatch):
    """Fingerprints that differ in the last bits only: all are held against all."""
    monkeypatch.setattr(slices, "ROWS", 64)
    rows = spark.createDataFrame([(i, True, [i]) for i in range(256)], "fp long, asks boolean, seqs array<long>")
    out = slices.earlier_counts(rows, dedup.slice_masks(3), 3)
    assert out.groupBy().sum("n").first()[0] == sum(apart(i, j) <= 3 for i in range(256) for j in range(i))


def test_counts_put_out_no_pairs(spark, monkeypatch):
    """Counting earlier copies used to join all near pairs of fingerprints."""

    def pairs(*_):
        raise AssertionError("all pairs were asked for")

    monkeypatch.setattr(dedup, "close_pairs", pairs)
    texts = ["the very same text of some length"] * 3 + ["short", "short", "", "another text that is like nothing else"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    got = {r.seq: (r.similar_records, r.hamming_distance) for r in dedup.check_prior(df).collect()}
    assert got == {0: (0, 64), 1: (1, 0), 2: (2, 0), 3: (0, 64), 4: (1, 0), 5: (0, 64), 6: (0, 64)}
