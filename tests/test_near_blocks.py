"""Vectors in bounded blocks and fingerprints under wide keys, against brute force."""

import math

import numpy as np
import pytest

from fieldtrust.operators import cluster, dedup


def points(seed, centres, each, d):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return np.concatenate([x + rng.normal(scale=0.12, size=(each, d)) for x in c])


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], "seq long, vector array<double>")


def brute(vectors, threshold):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    c = u @ u.T
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(c >= threshold), strict=True) if i < j}


@pytest.mark.parametrize("threshold", [0.6, 0.9, 0.97])
def test_pairs_equal_brute_force_in_small_blocks(spark, threshold, monkeypatch):
    monkeypatch.setattr(cluster.blocked, "__defaults__", (16, 8))
    x = points(3, 12, 25, 16)
    got = cluster.similar_pairs(frame(spark, x), threshold).collect()
    assert {(r.a, r.b) for r in got} == brute(x, threshold) and len(got) == len({(r.a, r.b) for r in got})


def test_far_blocks_never_meet(spark):
    x = points(4, 12, 40, 16)
    blocks = cluster.blocked(frame(spark, x), "seq", "vector", rows=20, pivots=32).cache()
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    meet = {(r.i, r.j) for r in cluster.meeting_blocks(blocks, 0.9).collect()}
    assert sum(sizes) == len(x) and max(sizes) <= 2 * 20 + 20
    every = len(sizes) * (len(sizes) + 1) // 2
    assert len(meet) < every / 3, (len(meet), every)
    of = {r.id: r.block for r in blocks.select("id", "block").collect()}
    assert all(tuple(sorted((of[a], of[b]))) in meet for a, b in brute(x, 0.9))


def test_many_equal_vectors_are_dealt_to_several_blocks(spark):
    blocks = cluster.blocked(frame(spark, np.ones((500, 4))), "seq", "vector", rows=50)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert sum(sizes) == 500 and max(sizes) < 150


def test_vectors_like_nothing_and_of_any_scale(spark):
    rows = [[1.0, 0.0], [1e200, 1e190], [1e-200, 0.0], [0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0], [None, 1.0], None, [], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]]
    assert sorted((r.a, r.b) for r in cluster.similar_pairs(frame(spark, rows), 0.9).collect()) == [(0, 1), (0, 2), (1, 2), (9, 10)]
    assert cluster.similar_pairs(frame(spark, []), 0.9).count() == 0
    assert cluster.similar_pairs(frame(spark, [None, [0.0]]), 0.9).count() == 0


@pytest.mark.parametrize("k", [1, 3, 5])
def test_close_fingerprints_equal_brute_force(spark, k):
    rng = np.random.default_rng(k)
    base = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    fps = set(base) | {b ^ sum(1 << int(p) for p in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 4, 5, 6, 7)}
    fps |= {base[0] ^ (1 << p) for p in range(64)}
    signed = sorted(f - 2**64 if f >> 63 else f for f in fps)
    want = {(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in enumerate(signed) for b in signed[i + 1 :]}
    got = [tuple(r) for r in dedup.close_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), k).collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in want if p[2] <= k}


def test_keys_are_of_about_half_the_bits():
    widths = [(m & (2**64 - 1)).bit_count() for m in dedup.slice_masks(3)]
    assert len(widths) == 20 and min(widths) >= 31
