"""Joins by distance, against small tables of places and among records."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions import geo
from fieldtrust.operators import radius, slices
from fieldtrust.operators.graph import checkpoint_dir
from fieldtrust.params import DEFAULT, Params

# fixed values: centre and radius (km) of the cities, and the water and closed points
CITIES = (
    ("北京", 39.9042, 116.4074, 50), ("上海", 31.2304, 121.4737, 50), ("广州", 23.1291, 113.2644, 40), ("深圳", 22.5431, 114.0579, 40), ("杭州", 30.2741, 120.1551, 30),
    ("南京", 32.0603, 118.7969, 30), ("成都", 30.5728, 104.0668, 30), ("武汉", 30.5928, 114.3055, 30), ("西安", 34.3416, 108.9398, 30), ("重庆", 29.5630, 106.5516, 30),
)
WATER = ((31.2304, 120.1551), (30.2741, 120.1551), (29.5630, 106.5516), (22.3, 114.2), (23.1, 113.3), (30.2, 121.5), (20.0, 110.0), (22.0, 113.5))
CLOSED = ((39.9, 116.4), (31.2, 121.5), (39.9042, 116.4074), (40.4319, 116.5704), (31.2304, 121.4737))
SIMPLE_WATER = ((31.2, 121.5), (22.3, 114.2))


def _within(lat: Column, lon: Column, points: tuple, km: float) -> Column:
    """Whether a point of a literal list is nearer than ``km``; the list is part of the plan, so nothing is joined."""
    return F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in points]), lambda q: geo.haversine_km(lat, lon, q["a"], q["b"]) < km)


def place_type(lat: Column, lon: Column) -> Column:
    """Water (1 km) before closed area (0.5 km) before normal; no roads are known."""
    return F.when(_within(lat, lon, WATER, 1.0), "water").when(_within(lat, lon, CLOSED, 0.5), "forbidden").otherwise("normal")


def near_water(lat: Column, lon: Column) -> Column:
    return _within(lat, lon, WATER, 2.0)


def near_closed(lat: Column, lon: Column) -> Column:
    return _within(lat, lon, CLOSED, 1.0)


def in_simple_water(lat: Column, lon: Column) -> Column:
    """The simple variant: under a tenth of a degree, as the crow flies on the map, from one of two points."""
    return F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SIMPLE_WATER]), lambda q: F.sqrt(F.pow(lat - q["a"], 2) + F.pow(lon - q["b"], 2)) < 0.1)


def _cities(lat: Column, lon: Column) -> Column:
    table = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(c).alias("city"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(r)).alias("r")) for i, (c, a, b, r) in enumerate(CITIES)])
    return F.transform(table, lambda q: F.struct(geo.haversine_km(lat, lon, q["a"], q["b"]).alias("km"), q["n"].alias("n"), q["city"].alias("city"), q["r"].alias("r")))


def containing_city(lat: Column, lon: Column) -> Column:
    """The first city of the list whose circle holds the point."""
    return F.get(F.filter(_cities(lat, lon), lambda q: q["km"] <= q["r"]), F.lit(0))["city"]


def nearest_city(lat: Column, lon: Column, limit_km: float = 100.0) -> Column:
    best = F.array_min(_cities(lat, lon))
    return F.when(best["km"] < limit_km, best["city"])


def verdict(lat: Column, lon: Column, system: str = "wgs84", p: Params = DEFAULT) -> Column:
    """Struct (valid, type, city, precision, warnings, latitude, longitude) of a coordinate; out of the country nothing else is looked at."""
    inside = geo.in_country(lat, lon, p)
    x, y = geo.convert(lat, lon, system, "wgs84")
    kind, level = place_type(x, y), geo.precision(x, y)["level"]
    edge = F.when(~x.between(p.lat_min, p.lat_max), "纬度超出中国范围").when(~y.between(p.lon_min, p.lon_max), "经度超出中国范围")
    said = F.array_compact(
        F.array(
            edge,
            F.when(kind == "water", "坐标位于水域附近").when(kind == "forbidden", "坐标位于禁区附近"),
            F.when(level == "very_high", "坐标精度非常高，可能为模拟数据").when(level == "medium", "坐标精度较低，建议使用更高精度的定位").when(level == "low", "坐标精度很低，可能存在定位错误"),
        )
    )
    moved = system != "wgs84"
    return F.struct(
        (inside & (kind != "forbidden")).alias("valid"),
        F.when(inside, kind).otherwise("normal").alias("type"),
        F.when(inside & edge.isNull(), containing_city(x, y)).alias("city"),
        F.when(inside, level).alias("precision"),
        F.when(inside, said).otherwise(F.array(F.lit("坐标超出中国范围"))).alias("warnings"),
        F.when(inside & F.lit(moved), x).alias("latitude"),
        F.when(inside & F.lit(moved), y).alias("longitude"),
    )


def info(lat: Column, lon: Column, p: Params = DEFAULT) -> Column:
    """Struct (is_valid, type, city, nearest_city, water_nearby, forbidden_nearby, precision)."""
    return F.struct(
        geo.in_country(lat, lon, p).alias("is_valid"), place_type(lat, lon).alias("type"), F.when(geo.in_country(lat, lon, p), containing_city(lat, lon)).alias("city"),
        nearest_city(lat, lon).alias("nearest_city"), near_water(lat, lon).alias("water_nearby"), near_closed(lat, lon).alias("forbidden_nearby"), geo.precision(lat, lon).alias("precision"),
    )


def neighbours(points: DataFrame, others: DataFrame, radius_m: float = 1000.0, key: str = "record_id") -> DataFrame:
    """Pairs of a point and the other points within a radius: (key, other key, metres).

    Both sides are dealt to cells a radius wide; a point asks its own cell and the cells around it, so the join is on equal
    cells. ``others`` needs ``other_id``, ``latitude``, ``longitude``. Cells span more degrees of longitude the nearer the pole;
    the few rows of cells around it have one column each. Each pair of rows meets in one cell, so nothing is made distinct afterwards.
    """
    step = radius_m / 111_000.0
    row = lambda lat: F.floor(lat / step)

    def width(r: Column) -> Column:
        """Cells in a degree of longitude, the same for all points of a row: none is narrower than the radius where it or a row beside it is nearest the pole."""
        low, high = (F.abs(r) - 1) * step, (F.abs(r) + 2) * step
        least = F.when(high < 90, F.cos(F.radians(high))).when(low > 90, F.abs(F.cos(F.radians(low)))).otherwise(0.0)
        half = math.sin(math.radians(min(step, 180.0)) / 2)
        return F.when(least > half, 1 / F.degrees(2 * F.asin(half / least))).otherwise(1 / 360.0)

    around = F.explode(F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)]))
    turn = F.greatest(F.floor(F.lit(360.0) * width(F.col("r"))), F.lit(1))
    a = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(key, F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    a = a.select("*", around.alias("dr")).withColumn("r", row(F.col("la")) + F.col("dr"))
    a = a.withColumns({"c0": F.floor(F.col("lo") * width(F.col("r"))), "turn": turn})
    # near a pole a row has so few cells that the three may be the same one
    a = a.select(key, "la", "lo", "r", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("c0") + d, F.col("turn")) for d in (-1, 0, 1)]))).alias("c"))
    b = others.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("other_id", F.col("latitude").alias("lb"), F.col("longitude").alias("lp")).withColumn("r", row(F.col("lb")))
    b = b.withColumn("c", F.pmod(F.floor(F.col("lp") * width(F.col("r"))), turn))
    m = geo.haversine_m(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))
    return a.join(b, ["r", "c"]).withColumn("metres", m).where(F.col("metres") <= radius_m).select(key, "other_id", "metres")


#: Cubes in which places are held against each other are so many radii wide, and so many cosines are held at once.
SIDE, COSINES = 4, 1 << 22


def _units(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _numbers(la: np.ndarray, lo: np.ndarray, lb: np.ndarray, lp: np.ndarray, w: np.ndarray, radius_m: float) -> np.ndarray:
    """How many of the weighted places ``(lb, lp)`` lie within the radius of each of ``(la, lo)``: by cosines, and by the great circle where these are too close to tell."""
    a, b, out = _units(la, lo), _units(lb, lp), np.zeros(len(la), np.int64)
    least, blur = math.cos(min(radius_m / (geo.EARTH_KM * 1000), math.pi)), 1e-12
    step = max(1, COSINES // len(b))
    one = bool((w == 1).all())
    for at in range(0, len(a), step):
        c = a[at : at + step] @ b.T
        inside = c >= least + blur
        out[at : at + step] = np.count_nonzero(inside, axis=1) if one else inside @ w
        i, j = np.nonzero(~inside & (c >= least - blur))
        if len(i):
            x, y, p, q = np.radians(la[at + i]), np.radians(lb[j]), np.radians(lo[at + i]), np.radians(lp[j])
            h = np.sin((y - x) / 2) ** 2 + np.cos(x) * np.cos(y) * np.sin((q - p) / 2) ** 2
            near = 2 * geo.EARTH_KM * 1000 * np.arcsin(np.sqrt(np.minimum(1.0, h))) <= radius_m
            np.add.at(out, at + i[near], w[j[near]])
    return out


def neighbour_numbers(points: DataFrame, others: DataFrame, radius_m: float = 1000.0, key: str = "record_id") -> DataFrame:
    """(key, n): how many of ``others`` lie within the radius of each of ``points``, of those that have any: ``neighbours`` counted, without a row for each pair.

    Equal places count once. Places lie in cubes around the earth's centre (so poles and the date line are no borders), others also in the
    cubes that their radius touches; a task compares the places of a cube and puts out a number for each. For radii with few places, or with crowds
    at one place; ``counts_within`` halves cubes where very many places lie within a radius.
    """
    chord = 2 * math.sin(min(radius_m / (2 * geo.EARTH_KM * 1000), math.pi / 2))
    reach, edge = chord * (1 + 1e-6), max(SIDE * chord, 2.0**-18)
    spark = points.sparkSession
    lat, lon = F.radians("la"), F.radians("lo")
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    at = lambda v: F.floor((v + 2) / edge)
    value = ((F.col("x") * (1 << 20) + F.col("y")) * (1 << 20) + F.col("z")).alias("value")

    def places(df: DataFrame) -> DataFrame:
        d = df.select(F.col("latitude").alias("la"), F.col("longitude").alias("lo")).where("la IS NOT NULL AND lo IS NOT NULL AND NOT isnan(la) AND NOT isnan(lo)")
        return d.groupBy("la", "lo").agg(F.count("*").alias("w"))

    asks = places(points).select("la", "lo", F.lit(0).cast("long").alias("w"), *[at(v).alias(k) for k, v in axes.items()])
    held = places(others)
    for k, v in axes.items():
        held = held.select("*", F.explode(F.array_distinct(F.array(at(v - reach), at(v + reach)))).alias(k))
    rows = asks.unionByName(held).select(F.lit(0).alias("choice"), value, "la", "lo", "w")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices.whole_keys(batches):
            la, lo, w = (t.column(c).to_numpy() for c in ("la", "lo", "w"))
            n, begin = np.zeros(len(la), np.int64), 0
            for end in slices.key_ends(t).tolist():
                mine = begin + np.flatnonzero(w[begin:end] == 0)
                theirs = begin + np.flatnonzero(w[begin:end] > 0)
                if len(mine) and len(theirs):
                    n[mine] = _numbers(la[mine], lo[mine], la[theirs], lo[theirs], w[theirs], radius_m)
                begin = end
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(la[some]), pa.array(lo[some]), pa.array(n[some])], ["la", "lo", "n"])

    found = rows.repartition(parts, "value").sortWithinPartitions("value").mapInArrow(run, "la double, lo double, n long")
    own = points.select(key, F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    return shuffled(own, found, ["la", "lo"]).groupBy(key).agg(F.sum("n").alias("n"))


#: A pair of cells with so many pairs of places, at most, is compared place by place; others are cut further.
COMPARED = 4096
#: The finest cells are so many halvings under the radius.
DEPTH = 16
#: Cells of the radius's size meet in cubes of so many doublings more.
MEETING = 2
#: A cube with more rows than these is not counted within a task.
HEAVY = 1 << 19


def shuffled(a: DataFrame, b: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input. Their sizes are guessed from compressed files, so that the smaller one would be broadcast, through the driver, at many times the limit."""
    return a.join(b.hint("merge"), on, how)


def _halved(places: DataFrame, radius_m: float) -> DataFrame:
    """``places(g, la, lo, asks, w)``, one row for each place of a group, to ``(g, la, lo, n)``: the sum of ``w`` within the radius, for places that ask and have any.

    Nothing is paired that need not be: places lie in cubes around the earth's centre, and pairs of cubes go down from the
    radius's size. A pair wholly within the radius adds its count to the cube, one wholly outside goes, and of the rest those
    with many places are halved; only pairs with few are compared place by place, by the great circle.
    """
    checkpoint_dir(places.sparkSession)
    chord = radius.chord(radius_m)
    fine = chord / (1 << DEPTH)
    lat, lon = F.radians("la"), F.radians("lo")
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    placed = places.select("*", *[F.floor((v + 1) / fine).alias(k) for k, v in axes.items()]).checkpoint()
    a, b = placed.where("asks"), placed.where("w > 0")
    cell = lambda level: F.struct(*[F.shiftright(k, DEPTH - level).alias(k) for k in axes])

    def cells(df: DataFrame, level: int, to: str) -> DataFrame:
        """Cells of a level with their places, how many rows these are, and the cell they lie in."""
        up = cell(max(0, level - 1)).alias(f"{to}_up")
        return df.groupBy("g", cell(level).alias(to), up).agg(F.count("*").alias(f"{to}_n"), F.sum("w").alias(f"{to}_w"))

    # cells and those beside them meet in larger ones, of which a cell with its neighbours touches one or two along each axis
    touched = lambda k: F.explode(F.array_distinct(F.array(F.shiftright(F.col(f"a.{k}") - 1, MEETING), F.shiftright(F.col(f"a.{k}") + 1, MEETING)))).alias(f"c{k}")
    around = cells(a, 0, "a").select("g", "a", "a_n", touched("x")).select("*", touched("y")).select("*", touched("z"))
    held = cells(b, 0, "b").select("g", "b", "b_n", "b_w", *[F.shiftright(F.col(f"b.{k}"), MEETING).alias(f"c{k}") for k in axes])
    beside = functools.reduce(Column.__and__, [F.abs(F.col(f"a.{k}") - F.col(f"b.{k}")) <= 1 for k in axes])
    pairs = shuffled(around, held, ["g", "cx", "cy", "cz"]).where(beside).select("g", "a", "a_n", "b", "b_n", "b_w")
    whole, few = [], []
    for level in range(DEPTH + 1):
        gaps = [F.abs(F.col(f"a.{k}") - F.col(f"b.{k}")) for k in axes]
        unit = float((1 << level) ** 2)
        least = sum((F.pow(F.greatest(d - 1, F.lit(0)), 2) for d in gaps), F.lit(0.0)) / unit
        most = sum((F.pow(d + 1, 2) for d in gaps), F.lit(0.0)) / unit
        pairs = pairs.withColumn("_kind", F.when(most < 1 - 1e-6, "whole").when(least > 1 + 1e-6, "none").when(F.lit(level == DEPTH) | (F.col("a_n") * F.col("b_n") <= COMPARED), "few").otherwise("many"))
        pairs = pairs.where("_kind <> 'none'").checkpoint()
        whole.append(pairs.where("_kind = 'whole'").groupBy("g", F.lit(level).alias("level"), "a").agg(F.sum("b_w").alias("n")))
        few.append(pairs.where("_kind = 'few'").select("g", F.lit(level).alias("level"), "a", "b"))
        many = pairs.where("_kind = 'many'")
        if level == DEPTH or not many.limit(1).count():
            break
        down = many.select("g", F.col("a").alias("a_up"), F.col("b").alias("b_up"))
        down = shuffled(shuffled(down, cells(a, level + 1, "a"), ["g", "a_up"]), cells(b, level + 1, "b"), ["g", "b_up"])
        pairs = down.select("g", "a", "a_n", "b", "b_n", "b_w")
    union = lambda parts: functools.reduce(DataFrame.unionAll, parts)
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), cell(i).alias("c")) for i in range(len(whole))])).alias("at")
    asks = a.select("g", "la", "lo", *axes, levels).select("g", "la", "lo", *axes, F.col("at.level").alias("level"), F.col("at.c").alias("a"))
    held = b.select("g", F.col("la").alias("lb"), F.col("lo").alias("lp"), *[F.col(k).alias(f"p{k}") for k in axes], "w", levels)
    held = held.select("g", "lb", "lp", *[f"p{k}" for k in axes], "w", F.col("at.level").alias("level"), F.col("at.c").alias("b"))
    inside = shuffled(asks, union(whole), ["g", "level", "a"]).select("g", "la", "lo", "n")
    close = shuffled(shuffled(asks, union(few), ["g", "level", "a"]), held, ["g", "level", "b"])
    # by whole steps of the finest cells; the great circle is worked out only where these cannot tell
    steps = sum((F.pow((F.col(k) - F.col(f"p{k}")).cast("double"), 2) for k in axes), F.lit(0.0))
    reach, blur = float(1 << DEPTH), 4.0
    near = (steps <= (reach - blur) ** 2) | ((steps <= (reach + blur) ** 2) & (geo.haversine_m(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")) <= radius_m))
    close = close.where(near).select("g", "la", "lo", F.col("w").alias("n"))
    return inside.unionAll(close).groupBy("g", "la", "lo").agg(F.sum("n").alias("n"))


def _located(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) < math.inf) & (F.abs(lon) < math.inf), F.lit(False))


def _totals(rows: DataFrame, radius_m: float, both: bool) -> DataFrame:
    """``rows(id, g, apart, la, lo, asks, counts)``, all with a place, to ``(id, la, lo, n, same)``: for each row that asks the rows that count within the radius, and with ``both`` those of its ``g`` (0 for a null one).

    Rows are sent once, to the cube of their place, and to the others that their radius touches (at ``radius.SIDE`` a twentieth
    more); a task counts its cubes. Only rows of a cube with too many of them for a task are summed up by place and counted by ``_halved``.
    """
    spark = rows.sparkSession
    rows = radius.with_cubes(rows, radius_m).withColumn("cubes", F.when(F.col("counts"), F.col("touched")).otherwise(F.array("home"))).drop("touched")

    def at(which: Column) -> DataFrame:
        """A row for each of these cubes: its number, whether the place lies in it and whether it is the row's first. What is asked of a cube lies in the exploded value, and empty arrays
        are let through: Spark would else put conditions on the cubes before everything, spelled out, and work them out for every row several times over."""
        told = F.transform(which, lambda c, i: F.struct(c.alias("value"), (c == F.col("home")).alias("own"), (i == 0).alias("first")))
        return rows.withColumn("at", F.explode_outer(told)).select(*rows.columns, "at.*").where("value IS NOT NULL")

    # each has so many rows that the list is short
    heavy = [r.value for r in at(F.col("cubes")).groupBy("apart", "value").count().where(F.col("count") > HEAVY).select("value").distinct().collect()]
    role = F.when(F.col("asks") & F.col("own"), 1).otherwise(0) + F.when(F.col("counts"), 2).otherwise(0)
    light = at(F.filter("cubes", lambda c: ~c.isin(heavy)) if heavy else F.col("cubes"))
    light = light.select(F.col("apart").alias("choice"), "value", "id", *(["g"] if both else []), "la", "lo", role.cast("byte").alias("role"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    kind, wide = rows.schema["id"].dataType.simpleString(), radius.edge(radius_m)
    out = light.repartition(parts, "choice", "value").sortWithinPartitions("choice", "value").mapInArrow(lambda batches: radius.in_cubes(batches, radius_m, wide, both), f"id {kind}, la double, lo double, n long, same long")
    if not heavy:
        return out
    crowded = at(F.filter("cubes", lambda c: c.isin(heavy)))
    checkpoint_dir(spark)
    places = crowded.where("first").groupBy("apart", "g", "la", "lo").agg(F.bool_or(F.col("asks") & F.col("home").isin(heavy)).alias("asks"), F.count_if("counts").alias("w")).checkpoint()
    every = _halved(places.groupBy(F.col("apart").cast("string").alias("g"), "la", "lo").agg(F.bool_or("asks").alias("asks"), F.sum("w").alias("w")), radius_m)
    found = shuffled(places.where("asks").withColumn("e", F.col("apart").cast("string")), every.withColumnRenamed("g", "e"), ["e", "la", "lo"], "left")
    if both:
        by = F.concat_ws(":", "apart", "g")
        own = _halved(places.where("g IS NOT NULL").select(by.alias("g"), "la", "lo", "asks", "w"), radius_m).toDF("s", "la", "lo", "same")
        found = shuffled(found.withColumn("s", F.when(F.col("g").isNotNull(), by)), own, ["s", "la", "lo"], "left")
    else:
        found = found.withColumn("same", F.lit(0))
    found = found.select(F.col("apart").alias("fa"), F.col("g").alias("fg"), F.col("la").alias("fla"), F.col("lo").alias("flo"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("same", F.lit(0)).cast("long").alias("same"))
    on = (F.col("apart") == F.col("fa")) & F.col("g").eqNullSafe(F.col("fg")) & (F.col("la") == F.col("fla")) & (F.col("lo") == F.col("flo"))
    return out.unionByName(shuffled(crowded.where("asks AND own").select("id", "apart", "g", "la", "lo"), found, on).select("id", "la", "lo", "n", "same"))


def _between(points: DataFrame, others: DataFrame, radius_m: float, key: str, by: str | None) -> DataFrame:
    """(key, n, same) of ``others`` within the radius of each of ``points`` with a coordinate: all, and those of an equal value of ``by``. A key with several points has one row."""

    def side(df: DataFrame, id_: Column, asks: bool) -> DataFrame:
        group = (F.lit(None) if by is None else F.col(by)).cast("string")
        lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
        flags = F.lit(0).alias("apart"), lat.alias("la"), lon.alias("lo"), F.lit(asks).alias("asks"), F.lit(not asks).alias("counts")
        return df.where(_located(lat, lon)).select(id_.alias("id"), group.alias("g"), *flags)

    rows = side(points, F.col(key), True).unionByName(side(others, F.lit(None).cast(points.schema[key].dataType), False))
    return _totals(rows, radius_m, by is not None).groupBy(F.col("id").alias(key)).agg(F.sum("n").alias("n"), F.sum("same").alias("same"))


def counts_within(points: DataFrame, others: DataFrame, radius_m: float = 1000.0, key: str = "record_id", by: str | None = None) -> DataFrame:
    """(key, n): how many of ``others(latitude, longitude)`` lie within the radius of each of ``points(key, latitude, longitude)``; with ``by`` only those of an equal value (0 for a null one). Points without a coordinate have no row; a key with several points has one."""
    return _between(points, others, radius_m, key, by).select(key, F.col("n" if by is None else "same").alias("n"))


def _density(n: Column, radius_m: float) -> Column:
    return F.least(F.coalesce(n, F.lit(0)) / (math.pi * (radius_m / 1000) ** 2) / 100, F.lit(1.0))


def _share(n: Column, same: Column) -> Column:
    return F.coalesce(F.when(n > 0, same / n), F.lit(0.0))


def spatial_density(points: DataFrame, others: DataFrame, key: str = "record_id", radius_m: float = 1000.0) -> DataFrame:
    """(key, density): others within the radius by square kilometre of its circle, by a hundred, 1 at most; 0 for (0, 0) and none. Others on the equator or the first meridian do not count."""
    n = counts_within(points.where("NOT (latitude = 0 AND longitude = 0)"), others.where("latitude <> 0 AND longitude <> 0"), radius_m, key)
    return shuffled(points.select(key).distinct(), n, key, "left").select(key, _density(F.col("n"), radius_m).alias("density"))


def neighbour_category_share(points: DataFrame, others: DataFrame, radius_m: float = 1000.0, category: str = "category", key: str = "record_id") -> DataFrame:
    """(key, category_share): of the others within the radius the share with the point's category; 0 where there are none or the point has none."""
    named = points.withColumn(category, F.nullif(F.col(category), F.lit("")))
    both = _between(named, others, radius_m, key, category)
    return shuffled(points.select(key).distinct(), both, key, "left").select(key, _share(F.col("n"), F.col("same")).alias("category_share"))


def density_and_share(reports: DataFrame, key: str = "record_id", radius_m: float = 1000.0, category: str = "category", apart: Column | None = None) -> DataFrame:
    """(key, density, category_share) for every row of ``reports(key, latitude, longitude, category)`` among all of them: ``spatial_density`` and ``neighbour_category_share`` in one, without a join and without those on the equator or the first meridian as others.

    Rows of different ``apart`` (a whole number) are never near each other. A row without a place has 0 for both.
    """
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    kind = F.col(category).cast("string")
    rows = reports.where(_located(lat, lon)).select(
        F.col(key).alias("id"), F.nullif(kind, F.lit("")).alias("g"), (F.lit(0) if apart is None else F.coalesce(apart, F.lit(0))).cast("int").alias("apart"),
        lat.alias("la"), lon.alias("lo"), F.lit(True).alias("asks"), ((lat != 0) & (lon != 0)).alias("counts"),
    )
    n = _totals(rows, radius_m, True)
    density = F.when((F.col("la") == 0) & (F.col("lo") == 0), 0.0).otherwise(_density(F.col("n"), radius_m))
    out = n.select(F.col("id").alias(key), density.alias("density"), _share(F.col("n"), F.col("same")).alias("category_share"))
    return out.unionByName(reports.where(~_located(lat, lon)).select(key, F.lit(0.0).alias("density"), F.lit(0.0).alias("category_share")))


def category_share(near: DataFrame, category: str = "category", other: str = "other_category", key: str = "record_id") -> DataFrame:
    """Share of a row's neighbours (joined rows) with its own category."""
    same = F.avg((F.col(category) == F.col(other)).cast("double"))
    return near.groupBy(key).agg(F.coalesce(same, F.lit(0.0)).alias("category_share"))


def platform_spread(matches: DataFrame, key: str = "record_id") -> DataFrame:
    """The greatest distance in metres between two platforms' coordinates of a record; a record has as many rows as platforms."""
    m = matches.where("found AND latitude <> 0 AND longitude <> 0")
    a, b = m.alias("a"), m.alias("b")
    far = geo.haversine_m(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.platform") < F.col("b.platform"))).groupBy(F.col(f"a.{key}").alias(key)).agg(F.max(far).alias("max_metres"))
