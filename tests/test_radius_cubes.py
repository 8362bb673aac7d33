"""Counts within a radius are made in tasks: against brute force with every cube in a task, with every cube halved between tasks, and with both; poles, the date line, crowds, copies."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import radius, spatial
from fieldtrust.plans import registry


def far(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1.0, max(0.0, h)))) * 1000


def rows_of(rng):
    places = [(rng.gauss(31.2, 0.02), rng.gauss(121.4, 0.02)) for _ in range(90)] + [(31.2, 121.4)] * 30 + [(31.2 + rng.random() * 1e-6, 121.41) for _ in range(40)]
    places += [(89.999, x) for x in (0.0, 90.0, 180.0, -90.0)] + [(10.0, 179.999), (10.0, -179.999), (10.0, 179.98), (-90.0, 5.0), (-90.0, 100.0), (0.0, 0.0), (0.0, 0.001), (0.002, 0.003)]
    places += [(95.0, 20.0), (85.0, -160.0), (31.2 + 1000 / 111194.9, 121.4)]
    return [(i, *p, (None, "", "x", "y")[rng.randrange(4)]) for i, p in enumerate(places)]


@pytest.mark.parametrize("heavy, side", [(1 << 19, 128), (0, 128), (60, 4)])
def test_both_numbers_equal_brute_force(spark, monkeypatch, heavy, side):
    monkeypatch.setattr(spatial, "HEAVY", heavy)
    monkeypatch.setattr(radius, "SIDE", side)
    rows = rows_of(random.Random(3))
    n = len(rows)
    rows += [(900, None, 1.0, "x"), (901, 2.0, None, "x"), (902, float("nan"), 1.0, "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "seq long, latitude double, longitude double, category string")
    got = {r.seq: (r.density, r.category_share) for r in spatial.density_and_share(df, "seq", apart=F.floor((F.col("latitude") + 90) / 180)).collect()}
    want = {k: (0.0, 0.0) for k in (900, 901, 902, None)}
    sheet = lambda r: (r[1] + 90) // 180
    for a in rows[:n]:
        near = [b for b in rows[:n] if b[1] and b[2] and sheet(a) == sheet(b) and far(a[1:3], b[1:3]) <= 1000]
        same = sum(bool(a[3]) and b[3] == a[3] for b in near)
        want[a[0]] = (0.0 if a[1] == a[2] == 0 else min(len(near) / 3.141592653589793 / 100, 1.0), same / len(near) if near else 0.0)
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    # the general forms, of points among others
    density = {r.seq: r.density for r in spatial.spatial_density(df.where("seq IS NOT NULL"), df.where("seq % 3 > 0"), "seq").collect()}
    share = {r.seq: r.category_share for r in spatial.neighbour_category_share(df.where("seq IS NOT NULL"), df.where("seq % 3 > 0"), key="seq").collect()}
    for a in rows[:n]:
        near = [b for b in rows[:n] if b[0] % 3 and far(a[1:3], b[1:3]) <= 1000]
        counted = sum(bool(b[1] and b[2]) for b in near)
        assert abs(density[a[0]] - (0.0 if a[1] == a[2] == 0 else min(counted / 3.141592653589793 / 100, 1.0))) < 1e-12
        assert abs(share[a[0]] - (sum(bool(a[3]) and b[3] == a[3] for b in near) / len(near) if near else 0.0)) < 1e-12


@pytest.mark.parametrize("paired, dense", [(0, 1 << 12), (8, 1), (1 << 16, 1), (1 << 16, 1 << 12)])
@pytest.mark.parametrize("metres, spread", [(1000.0, 0.02), (30.0, 0.001), (30_000.0, 1.0)])
def test_cells_are_halved_as_far_as_need_be(monkeypatch, paired, dense, metres, spread):
    monkeypatch.setattr(radius, "PAIRED", paired)
    monkeypatch.setattr(radius, "DENSE", dense)
    monkeypatch.setattr(radius, "STEP", 64)
    monkeypatch.setattr(radius, "CELLS", 16)
    rng = np.random.default_rng(5)
    la, lo = rng.normal(31.2, spread, 300), rng.normal(121.4, spread, 300)
    la[:60], lo[:60] = 31.2 + rng.random(60) * 1e-7, 121.4
    la[60:80], lo[60:80] = la[0], lo[0]
    wide = radius.edge(metres)
    at = np.floor((radius.units(la, lo) + 2) / wide).astype(np.int64)
    home = (at == at[0]).all(axis=1)
    group, asks, counts = rng.integers(0, 2, 300), home & (rng.random(300) < 0.8), rng.random(300) < 0.8
    o = np.argsort(group, kind="stable")
    cube = np.full(300, (at[0, 0] << 40) | (at[0, 1] << 20) | at[0, 2])
    near = np.array([radius.metres(la[i], lo[i], la, lo) <= metres for i in range(300)])
    touched = home | near[home].any(axis=0)  # others are not sent to the cube
    some = o[touched[o]]
    got = radius.counted(group[some], cube[some], la[some], lo[some], asks[some], counts[some], metres, wide)
    want = [(near[i] & counts & (group == group[i])).sum() if asks[i] else 0 for i in some]
    assert got.tolist() == want


def test_a_report_is_sent_once_and_nothing_is_joined(spark, sf_dir):
    """Each count used to write every place and every pair of cells to disk, three times over."""
    plan = registry.QUERIES["report_density"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "checkpoint" not in plan.lower()


def test_latitudes_beyond_a_pole_are_held_against_each_other(spark, tmp_path):
    """Event 1 is put at 95 degrees and another at 85 on the other side: one place on the globe, but the SQL compares latitudes first."""
    place = lambda e: (((e * 7919) % 20001 - 10000) / 100, ((e * 104729) % 40001 - 20000) / 100)
    seen, pair = {}, None
    for e in range(1, 4_000_000):
        if e % 4 == 0:
            continue
        la, lo = place(e)
        if 80 < la < 90:
            seen[round(la * 100), round(lo * 100) % 36000] = e
        elif 90 < la < 100 and (18000 - round(la * 100), (round(lo * 100) + 18000) % 36000) in seen:
            pair = seen[18000 - round(la * 100), (round(lo * 100) + 18000) % 36000], e
            break
    assert pair
    spark.createDataFrame([(e, "view") for e in pair], "event_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in registry.QUERIES["report_density"](spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(e, 3183, 1000000) for e in sorted(pair)]
