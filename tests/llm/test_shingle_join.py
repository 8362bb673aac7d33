"""The pipeline's near-duplicates against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np

from fieldtrust.llm import shingle_join


def _shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_edited_copies_are_found(spark, sf_dir):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 9, 40, 150]))]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    line = " ".join(words[:12])
    texts += [f"{line} {' '.join(rng.choice(words) for _ in range(30))}" for _ in range(30)]  # a common line makes no copy
    texts += ["", " \n", texts[3].upper()]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(None, texts[0], 1000), (3, texts[90], 1001)]  # an id with two texts
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [_shingles(t) for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not a and not b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert 10 < len({find(i) for i in range(len(texts))}) < len(texts) - 8
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    groups = sorted(find(texts.index(r.text)) for r in got)
    assert groups == sorted({find(i) for i in range(len(texts))})
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "e f g h")], "doc_id long, text string")
    assert sorted(r.text for r in shingle_join.keep_one(nameless).collect()) == ["a b c d", "e f g h"]


def test_sketches_lose_no_alike_pair():
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 3, 40, 129, 700, 2600):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for share in (0, 0.02, 0.05, 0.1, 0.2, 0.6):
            other = base.copy()
            k = int(n * share)
            other[:k] = rng.integers(0, 2**64, k, dtype=np.uint64)
            sets.append(np.unique(other[: n - int(rng.integers(0, n // 8 + 1))]))
    members = [(i, i, False, len(x), shingle_join.sketch(x)) for i, x in enumerate(sets)]
    alike = np.array([[i != j and shingle_join.similar(x, y) for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    for i, row in enumerate(alike):
        for j in np.flatnonzero(row):
            a, b = shingle_join.partners([members[i]], [members[j]])
            assert a[0] and b[0]
    a, _ = shingle_join.partners([members[18]], [members[24]])  # 129 and 700 other shingles
    assert not a[0] and alike.sum() > 30
    same = shingle_join._folded([shingle_join.sketch(sets[24])], 32)
    assert same.shape == (1, 256) and set(np.unique(same)) == {-1.0, 1.0}
    apart, _ = shingle_join.partners(members[12:18], None)
    linked = shingle_join.tile_links([(i, i, False, x) for i, x in enumerate(sets[12:18])], None)
    assert set(linked[0]) | set(linked[1]) <= set(np.flatnonzero(apart).tolist())


def test_equal_rows_are_kept_once(spark):
    rows = [(5, "a b c d e f", 1)] * 3 + [(6, "a b c d e f", 1), (5, "g h i j k l", 2), (None, "", 3), (None, None, 3)]
    got = shingle_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, at int")).collect()
    assert sorted((r.doc_id or 0, r.at) for r in got) == [(0, 3), (5, 1), (5, 2)]


def test_clusters_are_the_components_of_the_pairs():
    rng = np.random.default_rng(5)
    for p, q, own in ((9, 9, True), (60, 60, True), (1, 7, False), (40, 70, False)):
        may = rng.random((p, q)) < 1.2 / max(p, q)
        may = may | may.T if own else may
        got = shingle_join.clusters(may, own)
        root = list(range(len(got)))
        for _ in root:
            for i, j in zip(*np.nonzero(may), strict=True):
                root[i] = root[j if own else p + j] = min(root[i], root[j if own else p + j])
        assert got.tolist() == root
    path = np.eye(300, k=1, dtype=bool)
    assert not shingle_join.clusters(path | path.T, True).any()
