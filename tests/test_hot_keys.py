"""Devices and places that hold very many rows, against row loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldtrust.operators import geo_rules, spatial, workflow

KIND = "seq long, device_id string, timestamp long, latitude double, longitude double"


def reports(n=600, seed=3):
    """Half of the rows are one device's; times do not fall, and some rows share an instant."""
    rng, t, out = random.Random(seed), 1_000_000, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 7, 59, 60, 1500])
        out.append((i, "hot" if i % 2 else rng.choice(["a", "b", "", None]), t, rng.choice([31.2, 39.9, 95.0, None]), rng.choice([121.4, 116.4, 121.4, 300.0])))
    return out


def test_rates_by_slices(spark, monkeypatch):
    monkeypatch.setattr(geo_rules, "SLICE", 7200)
    rows = reports()
    got = {r.seq: (r.minute_count, r.hour_count) for r in geo_rules.with_rates(spark.createDataFrame(rows, KIND)).collect()}
    for i, d, t, *_ in rows:
        earlier = [x[2] for x in rows[: i + 1] if x[1] == d]
        assert got[i] == (sum(x > t - 60 for x in earlier), sum(x > t - 3600 for x in earlier)), i


def test_no_task_has_a_devices_rows(spark):
    """A burst of one device in a second: seconds are counted before they meet in a window."""
    n = 5000
    df = spark.range(n).select(F.col("id").alias("seq"), F.lit("hot").alias("device_id"), (F.col("id") / 2500).cast("long").alias("timestamp"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    got = geo_rules.with_rates(df).agg(F.max("minute_count").alias("m"), F.sum("minute_count").alias("s")).first()
    assert got.m == n and got.s == n * (n + 1) // 2
    assert geo_rules.with_rates(df.where("false")).count() == 0


def test_previous_places_by_blocks(spark):
    rows = reports()
    for order, block in ((("seq",), 16), (("timestamp", "seq"), 3000)):
        got = {r.seq: (r.prev_lat, r.prev_lon, r.prev_ts) for r in geo_rules.with_previous(spark.createDataFrame(rows, KIND), order=order, block=block).collect()}
        last: dict = {}
        for i, d, t, lat, lon in sorted(rows, key=lambda r: (r[2], r[0]) if len(order) > 1 else r[0]):
            ok = bool(d) and lat is not None and abs(lat) <= 90 and abs(lon) <= 180
            assert got[i] == (last.get(d, (None, None, None)) if ok else (None, None, None)), i
            if ok:
                last[d] = (lat, lon, float(t))
        assert len(got) == len(rows)


def far(a, b):
    r = [math.radians(x) for x in (*a, *b)]
    h = np.sin((r[2] - r[0]) / 2) ** 2 + np.cos(r[0]) * np.cos(r[2]) * np.sin((r[3] - r[1]) / 2) ** 2
    return 2 * 6371000 * np.arcsin(np.sqrt(min(1.0, h)))


def test_counts_within_a_radius(spark, monkeypatch):
    monkeypatch.setattr(spatial, "COMPARED", 8)
    rng = random.Random(7)
    places = [(rng.gauss(31.2, 0.006), rng.gauss(121.4, 0.006)) for _ in range(120)] + [(31.2, 121.4)] * 60 + [(89.999, x) for x in (0.0, 90.0, 180.0, -90.0)]
    places += [(10.0, 179.999), (10.0, -179.999), (10.0, 179.98), (-90.0, 5.0), (-90.0, 100.0), (0.0, 0.0), (31.2 + 1000 / 111194.9, 121.4)]
    rows = [(i, *p, "x" if i % 3 else None if i % 2 else "y") for i, p in enumerate(places)] + [(900, None, 1.0, "x"), (901, 2.0, None, "x")]
    df = spark.createDataFrame(rows, "record_id long, latitude double, longitude double, category string")
    near = {(a[0], b[0]) for a in rows[: len(places)] for b in rows[: len(places)] if far(a[1:3], b[1:3]) <= 1000}
    got = {r.record_id: r.n for r in spatial.counts_within(df, df).collect()}
    assert got == {i: sum((i, j) in near for j in range(len(places))) for i in range(len(places))}
    own = {r.record_id: r.n for r in spatial.counts_within(df, df, by="category").collect()}
    kind = [r[3] for r in rows]
    assert own == {i: sum((i, j) in near and kind[j] == kind[i] for j in range(len(places))) if kind[i] else 0 for i in range(len(places))}
    assert spatial.counts_within(df.where("false"), df).count() == 0
    assert {r.n for r in spatial.counts_within(df.where("record_id < 9"), df.where("false")).collect()} == {0}


def test_a_crowd_is_counted_and_not_paired(spark, monkeypatch):
    """With distances between places made infinite, counts can only come from cubes that lie within the radius as a whole."""
    n = 5000
    df = spark.range(n).select(F.col("id").alias("record_id"), (F.lit(31.2) + F.col("id") * 1e-9).alias("latitude"), F.lit(121.4).alias("longitude"))
    monkeypatch.setattr(spatial, "COMPARED", 0)
    monkeypatch.setattr(spatial.geo, "haversine_m", lambda *_: F.lit(float("inf")))
    got = spatial.counts_within(df, df).collect()
    assert len(got) == n and {r.n for r in got} == {n}


def test_of_a_keys_changes_the_last_holds(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame([(1, "x", 1, "upsert"), (1, "y", 2, "upsert"), (2, "z", 3, "upsert"), (2, None, 4, "delete"), (4, None, 5, "delete"), (4, "n", 6, "upsert"), (None, "q", 7, "upsert")], "k int, v string, seq int, op string")
    assert sorted(map(tuple, workflow.merged(old, changes, "k").collect())) == [(1, "y"), (3, "c"), (4, "n")]
