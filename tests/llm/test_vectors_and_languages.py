"""Vector codes, centroid clusters and languages against brute force and on awkward rows."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtrust.llm import language_id, vector_codes, yinyang
from fieldtrust.llm.vector_blocks import limit, pack, unpack

KIND = "vec_id long, embedding array<double>, label int"


def lloyd(x, centroids, rounds):
    """Every row against every centroid; returns centroids and assignment."""
    c = centroids.copy()
    for i in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if i == rounds:
            return c, a, d[np.arange(len(x)), a]
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].sum(axis=0) // (a == j).sum()


def vectors(n, width, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (9, width))
    x = middle[rng.integers(0, 9, n)] + rng.normal(0, spread, (n, width))
    x[n // 2 : n // 2 + n // 4] = x[0]  # a group of equal vectors
    return x


@pytest.mark.parametrize("seed", range(6))
def test_filtering_assigns_as_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n, w, k = int(rng.integers(1, 700)), int(rng.integers(1, 9)), int(rng.integers(1, 17))
    points = rng.integers(-6, 7, (n, w)) * int(rng.choice([1, 50]))
    points[: n // 3] = points[0]
    entries = points[rng.integers(0, n, k)] + rng.integers(-1, 2, (k, w))
    entries[-1] = entries[0]  # ties go to the lower index
    tree = vector_codes.build(points, leaf=4)
    want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    sums, counts, got = vector_codes.filtered(tree, entries, label=True)
    assert (got == want).all() and (counts == np.bincount(want, minlength=k)).all()
    assert (sums == np.stack([points[want == j].sum(axis=0) for j in range(k)])).all()


def test_filtering_takes_whole_subtrees():
    points = np.concatenate([np.zeros((512, 2), np.int64), np.full((512, 2), 1000)])
    tree = vector_codes.build(points)
    tree.points[:] = 10**6  # no leaf is looked into, so spoilt points do no harm
    assert vector_codes.filtered(tree, np.array([[1, 1], [999, 999]]))[1].tolist() == [512, 512]


def test_codes_by_brute_force(spark):
    x = vectors(500, 24, 1)
    rows = [(int(i * 7 % 500), v.tolist(), None if i % 5 == 0 else int(i % 3)) for i, v in enumerate(x)]
    got = vector_codes.encode(spark.createDataFrame(rows, KIND).repartition(3)).toPandas().set_index("vec_id")
    rows.sort()
    whole = np.floor(4096 * np.array([r[1] for r in rows])).astype(np.int64)
    books, codes, error = [], [], 0
    for p in range(8):
        part = whole[:, p * 3 : p * 3 + 3]
        c, a, d = lloyd(part, part[:16], 6)
        books.append(c)
        codes.append(a)
        error = error + d
    want = pd.DataFrame({"vec_id": [r[0] for r in rows], "error": error, "label": [-1 if r[2] is None else r[2] for r in rows]}).set_index("vec_id")
    assert got["code"].loc[want.index].tolist() == ["".join(f"{j:02x}" for j in r) for r in np.stack(codes, axis=1).tolist()]
    assert (got["error"].loc[want.index] == want.error).all()
    assert (got["label_error"].loc[want.index] == want.groupby("label").error.transform("sum")).all()
    numbers = ",".join(str(z) for b in books for z in b.ravel().tolist())
    assert set(got["codebooks_sha256"]) == {hashlib.sha256(numbers.encode()).hexdigest()}


def test_codes_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [float(i) for i in range(8)]
    rows = [(1, None, 1), (2, [nan] * 8, 1), (3, [inf] + v[1:], 1), (4, [None] + v[1:], 1), (5, v, 1), (5, v, 1), (6, v[::-1], None), (None, v, None), (7, v * 2, 1), (8, [], 1), (9, [1e30] * 8, 2), (2**60 + 1, v, 1)]
    docs = spark.createDataFrame(rows, KIND).withColumn("code", F.lit("mine")).withColumn("error", F.lit(1.5))
    got = vector_codes.encode(docs).toPandas()
    assert got.columns.tolist() == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    ids = [None if pd.isna(i) else int(i) for i in got["vec_id"].astype(object)]
    assert sorted(i for i in ids if i is not None)[:4] == [5, 5, 6, 9] and None in ids and len(ids) == 6
    assert vector_codes.encode(docs.where("vec_id is not null")).where(f"vec_id = {2**60 + 1}").count() == 1
    assert got["error"].tolist() == [0] * 6 and set(got["label_error"]) == {0}
    empty = vector_codes.encode(docs.where("false"))
    assert empty.count() == 0 and empty.columns == got.columns.tolist()


def test_codes_with_many_labels(spark, monkeypatch):
    """Beyond the broadcast bound the totals of labels are joined by a shuffle, with the same rows."""
    df = spark.createDataFrame([(i, v.tolist(), i % 40) for i, v in enumerate(vectors(200, 8, 3))], KIND)
    want = sorted(map(tuple, vector_codes.encode(df).collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 3)
    assert sorted(map(tuple, vector_codes.encode(df).collect())) == want


@pytest.mark.parametrize("seed", range(6))
def test_yinyang_passes_as_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 600)), int(rng.integers(1, 17))
    x = rng.integers(-40, 41, (n, 6)) if seed % 2 else np.floor(64 * vectors(max(n, 8), 6, seed, 0.05)).astype(np.int64)
    c = x[rng.integers(0, len(x), k)]
    of = yinyang.grouped(c, 4)
    a, upper, lower, _ = yinyang.first_pass(x, c, of)
    taken = 0
    for _ in range(5):
        new = np.stack([x[a == j].sum(axis=0) // (a == j).sum() if (a == j).any() else c[j] for j in range(k)])
        a, upper, lower, some = yinyang.later_pass(x, a, upper, lower, c, new, of)
        taken += some
        c = new
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (a == d.argmin(axis=1)).all()
        roots = np.sqrt(d.astype(float))
        assert (upper + 1e-6 >= roots[np.arange(len(x)), a]).all()
        roots[np.arange(len(x)), a] = np.inf
        assert all((lower[:, g] <= roots[:, of == g].min(axis=1) + 1e-6).all() for g in range(of.max() + 1))
    if seed % 2 == 0 and k > 8 and len(x) > 100:
        assert taken < 0.7 * 5 * len(x) * k  # the bounds pass over most distances of well parted vectors


def test_clusters_by_brute_force(spark):
    x = vectors(400, 64, 2)
    rows = [(int(i * 3 % 400), v.tolist(), 0) for i, v in enumerate(x)]
    got = yinyang.cluster(spark.createDataFrame(rows, KIND).repartition(3)).toPandas().set_index("vec_id")
    rows.sort(key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    whole = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64)
    c, a, d = lloyd(whole, whole[:16], 3)
    ids = [r[0] for r in rows]
    assert (got["cluster"].loc[ids] == a).all() and (got["distance"].loc[ids] == d).all() and set(got["inertia"]) == {d.sum()}
    assert (got["cluster_inertia"].loc[ids] == [d[a == j].sum() for j in a]).all()
    assert got["centroid_sha256"].loc[ids].tolist() == [hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest() for j in a]


def test_clusters_of_awkward_rows(spark):
    v = [0.5] * 64
    rows = [(1, None, 1), (2, [float("nan")] * 64, 1), (3, v[1:], 1), (4, [None] + v[1:], 1), (5, v, 1), (5, v, 1), (None, [1.0] * 64, None), (6, [-1e20] * 64, 1), (7, [], 0), (2**60 + 1, v, 1)]
    df = spark.createDataFrame(rows, KIND).withColumn("cluster", F.lit("mine")).withColumn("distance", F.lit(0.1))
    got = yinyang.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    out = got.collect()
    assert sorted(r.vec_id for r in out if r.vec_id is not None) == [5, 5, 6, 2**60 + 1] and len(out) == 5
    assert {r.distance for r in out} == {0} and len({r.cluster for r in out if r.vec_id == 5}) == 1
    assert yinyang.cluster(df.where("false")).count() == 0


def test_whole_numbers_pack_and_keep_within_a_long():
    for x in (np.zeros(0, np.int64), np.array([-128, 127]), np.array([128]), np.array([-(2**40), 5]), np.array([2**15 - 1, -(2**15)])):
        raw, size = pack(x)
        assert (unpack(raw, size, len(x)) == x).all()
    for w in (1, 8, 64, 4096):
        assert w * (2 * limit(w)) ** 2 < 2**63


def test_languages_of_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.query(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all() and got.accepted.mean() > 0.9


def test_calibration_is_held_to_errors():
    rng = np.random.default_rng(0)
    truth = rng.normal(0, 2, (4000, 3))
    y = np.array([rng.choice(3, p=p) for p in language_id.softmax(truth)])
    t, reject = language_id.calibrate(truth * 5, y)
    assert 4 < t < 6 and 0 < reject < 1
    p = language_id.softmax(truth * 5 / t)
    right = p.argmax(axis=1) == y
    assert abs((p.max(axis=1)[right] < reject).mean() - language_id.REJECTED) < 0.005


def test_languages_of_awkward_rows(spark):
    rows = [(i, ("the house and the garden " if i % 2 else "der hund und die katze ") * (1 + i % 4), "en" if i % 2 else "de", 0.5) for i in range(80)]
    odd = [(100, None, "en", 0.1), (101, "", "de", 0.1), (102, "12 34 !?", "en", 0.1), (None, "the garden and the house", None, None), (103, "und die katze " * 40000, None, 0.2), (103, "und die katze", None, 0.2), (104, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "xx", 1.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    model = language_id.train(docs)
    assert model.langs == ["de", "en"]
    out = language_id.predicted(docs, model)
    got = {r.doc_id: r for r in out.where("doc_id >= 100 or doc_id is null").collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 104)] == ["und"] * 4 and got[100].score == 0 and not got[100].accepted
    assert got[None].lang_pred == "en" and got[None].held_out is False and got[103].lang_pred == "de"
    assert out.count() == docs.count() and out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "accepted", "held_out"]
    assert language_id.train(docs.where("false")) is None
    assert {r.lang_pred for r in language_id.predicted(docs, None).collect()} == {"und"} and language_id.predicted(docs.where("false"), model).count() == 0


def test_subwords_by_a_plain_loop():
    text = "Über-Maß 3x ÉTÉ"
    got = language_id.subwords(text)
    words = [" " + w + " " for w in "über maß x été".split()]
    grams = [w[i : i + n] for w in words for n in language_id.LENGTHS for i in range(len(w) - n + 1) if w[i : i + n].strip()]
    assert got.sum() == len(grams)
    assert (got == language_id.subwords("x été maß über")).all() and not language_id.subwords("12 !").any()


def test_large_ids_beside_a_null_id(spark):
    """A null id in a chunk leaves its other ids as they are (pandas would make doubles of such a list)."""
    from fieldtrust.llm import lm, repeats
    from fieldtrust.llm.common import fold

    ids = [2**60 + 1, None, 2**60 + 2, 2**63 - 1]
    text = "a passage that is well over fifty bytes long and stands in every one of them"
    docs = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").coalesce(1)
    want = {r.doc_id: r.h for r in docs.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("h")).collect()}
    got = lm.scores(docs).collect()
    assert {r.doc_id: r.held_out for r in got} == want and len(got) == 4
    assert got[0].train_tokens == sum(not h for h in want.values()) * (len(text.split()) + 1)
    gone = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    assert gone == {2**60 + 1: 0, None: len(text), 2**60 + 2: len(text), 2**63 - 1: len(text)}
