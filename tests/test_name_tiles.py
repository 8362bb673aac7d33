"""Names meet the tiles of their group with what they have found before, and bounds of two tiles are one matrix product."""

import random

import numpy as np
from pyspark.sql import functions as F

from fieldtrust.operators import names

WORDS = (("blue", "cold", "large", "new", "old", "red"), ("bolt", "gear", "plate", "ring", "rod"), ("economy", "large", "promo", "small"))


def test_no_tile_begins_anew(spark, monkeypatch):
    monkeypatch.setattr(names, "TILE", 16)
    rng = random.Random(8)
    rows = {" ".join((*(rng.choice(w) for w in WORDS), str(rng.randrange(50)))) for _ in range(700)}
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sorted(rows))], "record_id long, name string")
    n = names.best_name_match(df).agg(F.avg("n_ratios")).first()[0]
    assert n < 15  # with some forty tiles: a ratio or more for each of them before


def test_shared_characters_are_the_lesser_counts():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40, (5, names.BINS)), rng.integers(0, 3, (7, names.BINS))
    for x, y in ((a, b), (a, a), (b, b), (a, b * 0), (a[:0], b)):
        assert (names.shared(x, y) == np.minimum(x[:, None], y[None]).sum(axis=2)).all()
    assert (names.counted(["", "aab", "店"]).sum(axis=1) == [0, 3, 1]).all()
