"""Neighbours counted in cubes against brute force: poles, the date line, crowds at a place."""

import random

from fieldtrust.operators import spatial
from fieldtrust.plans import registry
from tests.test_hot_keys import far


def test_numbers_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "COSINES", 64, raising=False)
    rng = random.Random(7)
    places = [(rng.gauss(31.2, 0.02), rng.gauss(121.4, 0.02)) for _ in range(80)] + [(31.2, 121.4)] * 30 + [(89.999, x) for x in (0.0, 90.0, 180.0, -90.0)]
    places += [(10.0, 179.999), (10.0, -179.999), (10.0, 179.98), (-90.0, 5.0), (-90.0, 100.0), (0.0, 0.0), (50.0, 50.0)]
    rows = [(i, *p) for i, p in enumerate(places)] + [(900, None, 1.0), (901, 2.0, None), (902, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "seq long, latitude double, longitude double")
    got = {r.seq: r.n for r in spatial.neighbour_numbers(df, df.where("seq <> 119"), 1000.0, "seq").collect()}
    want = {i: sum(far(a, b) <= 1000 for j, b in enumerate(places) if j != 119) for i, a in enumerate(places)}
    assert got == {i: n for i, n in want.items() if n}
    assert spatial.neighbour_numbers(df.where("false"), df, 1000.0, "seq").count() == 0


def test_neighbours_are_counted_and_not_paired(spark, sf_dir, monkeypatch):
    """The query used to make a row for each pair."""

    def pairs(*_):
        raise AssertionError("pairs were asked for")

    monkeypatch.setattr(spatial, "neighbours", pairs)
    assert registry.QUERIES["neighbour_counts"](spark, sf_dir).count() > 0
