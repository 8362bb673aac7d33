"""Neighbours near the poles against brute force."""

import math
import random

import pytest

from fieldtrust.operators import spatial


@pytest.mark.parametrize("radius", [1000.0, 30_000.0])
def test_polar_neighbours(spark, radius):
    rng = random.Random(9)
    lats = [80 + rng.random() * 10 for _ in range(150)] + [90 - rng.random() * radius / 30_000 for _ in range(150)] + [90.0, 90.0]
    pts = [(i, lat * rng.choice([-1, 1]), rng.uniform(-180, 180) if i % 3 else rng.uniform(-180, -170)) for i, lat in enumerate(lats)]
    pts += [(1000 + i, lat + rng.uniform(-1, 1) * radius / 111_000 if abs(lat) < 89 else lat, (lon + 180 + rng.uniform(-1, 1) * 8) % 360 - 180) for i, lat, lon in pts]
    df = spark.createDataFrame(pts, "record_id long, latitude double, longitude double")

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))

    want = {(a[0], b[0]) for a in pts for b in pts if metres(a, b) <= radius}
    got = {(r.record_id, r.other_id) for r in spatial.neighbours(df, df.withColumnRenamed("record_id", "other_id"), radius).collect()}
    assert got == want
