"""The likest name, against all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from fieldtrust.operators import names
from fieldtrust.plans import joins
from fieldtrust.plans import tables as t

KIND = "record_id long, name string, brand string"


def all_pairs(rows, others=None):
    out = {}
    for i, (key, n, g) in enumerate(rows):
        best = (0.0, None)
        for j, (o, h) in enumerate((r[1], r[2]) for r in (others or rows)):
            if n and o and g is not None and h == g and (others is not None or i != j):
                r = SequenceMatcher(None, n, o).ratio()
                if r > best[0] or (r == best[0] and (best[1] is None or o < best[1])):
                    best = (r, o)
        out[key] = best
    return out


def made(n, seed, alphabet="abcd 店咖啡"):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 9, 14, 30]))), rng.choice(["x", "x", "y", None])) for i in range(n)]
    return rows + [(900, None, "x"), (901, "", "x"), (902, "alone", "z"), (903, rows[0][1], rows[0][2])]


def test_among_others(spark, monkeypatch):
    monkeypatch.setattr(names, "TILE", 16)
    rows = made(150, 1)
    got = {r.record_id: (r.text_similarity, r.match) for r in names.best_name_match(spark.createDataFrame(rows, KIND), group="brand").collect()}
    assert got == all_pairs(rows)


def test_against_a_table(spark):
    rows, other = made(60, 2), made(80, 3)
    a, b = spark.createDataFrame(rows, KIND), spark.createDataFrame(other, KIND)
    got = {r.record_id: (r.text_similarity, r.match) for r in names.best_name_match(a, b, group="brand").collect()}
    assert got == all_pairs(rows, other)
    assert {r.text_similarity for r in names.best_name_match(a, b.where("false")).collect()} == {0.0}
    assert names.best_name_match(a.where("false"), b).count() == 0


def test_parts_within_a_brand(spark, sf_dir):
    p = t.read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type"), F.col("p_size").cast("string")).alias("n"), "p_brand")
    want = all_pairs([tuple(r) for r in p.collect()])
    got = joins.name_matches(spark, sf_dir).collect()
    assert {r.p_partkey: (r.similarity_m, r.match) for r in got} == {k: (int(s * 1e6 + 0.5), m) for k, (s, m) in want.items()}


def test_bounds_leave_most_ratios_out():
    rng = random.Random(4)
    rows = ["".join(rng.choice("abcdefghijklmnop") for _ in range(16)) for _ in range(200)]
    rows += [r[:-1] + "q" for r in rows]
    best, match = np.zeros(len(rows)), [None] * len(rows)
    taken = names.best_of(rows, best, match, rows, True).sum()
    assert taken < 0.02 * len(rows) ** 2 and min(best) > 0.9
