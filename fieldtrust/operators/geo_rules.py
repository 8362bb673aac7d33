"""Coordinate and movement rules over records.

State that a row loop would keep (earlier positions, arrival times) is windows over the device's rows in the order of
``seq``, by slices of time and blocks of arrivals that carry over what the next ones need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtrust.functions import geo, scoring
from fieldtrust.operators.layout import SEQ_BLOCK, running_count
from fieldtrust.params import DEFAULT, Params


def anomaly(kind: str | Column, description: Column, severity: float | Column, **details: Column) -> Column:
    """An anomaly struct; details become text."""
    flat = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    as_map = F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    severity = F.lit(float(severity)) if not isinstance(severity, Column) else severity.cast("double")
    return F.struct(kind.alias("type"), description.cast("string").alias("description"), severity.alias("severity"), as_map.alias("details"))


def invalid_coordinate(lat: Column, lon: Column) -> Column:
    return F.when(~geo.is_valid(lat, lon), anomaly("invalid_coordinate", F.concat_ws("", F.lit("坐标无效: "), lat.cast("string"), F.lit(", "), lon.cast("string")), 1.0, latitude=lat, longitude=lon))


def out_of_range(lat: Column, lon: Column, p: Params = DEFAULT) -> Column:
    """Outside the country and, on both axes, more than five degrees from the nearest edge."""
    far_lat = F.least(F.abs(lat - p.lat_min), F.abs(lat - p.lat_max)) > p.edge_degrees
    far_lon = F.least(F.abs(lon - p.lon_min), F.abs(lon - p.lon_max)) > p.edge_degrees
    text = F.concat(F.lit("坐标超出中国境内范围: ("), lat.cast("string"), F.lit(", "), lon.cast("string"), F.lit(")"))
    return F.when(~geo.in_country(lat, lon, p) & far_lat & far_lon, anomaly("out_of_range", text, 0.8, latitude=lat, longitude=lon))


#: Seconds of a time slice, and arrivals of a block: what one task holds of a device at most, with what it carries over.
SLICE, HOUR = 6 * 3600, 3600


def with_rates(df: DataFrame, device: str = "device_id", ts: str = "timestamp", seq: str = "seq") -> DataFrame:
    """Adds ``minute_count`` and ``hour_count``: arrivals of the device so far in the last 60 and 3600 seconds.

    For rows whose times do not fall as ``seq`` (a unique long) rises; the lower bound is exclusive, the row itself counts, and rows of
    the same instant that come later do not. Times are whole seconds. Arrivals are first counted by device and second; the
    seconds of a device are cut into slices, each with the last hour of the slice before, so that no task has more than a
    slice's seconds of a device however many rows it has. Rows of one second are ranked by blocks of ``seq``.
    """
    rows = df.withColumn("_at", F.struct(F.col(device).alias("d"), F.col(ts).cast("long").alias("t")))
    rows = running_count(rows, [F.col("_at")], seq, "_nth")
    seconds = rows.groupBy("_at").agg(F.count("*").alias("_n"))
    own = F.floor(F.col("_at.t") / SLICE)
    next_too = F.when(F.pmod(F.col("_at.t"), F.lit(SLICE)) > SLICE - HOUR, F.array(own, own + 1)).otherwise(F.array(own))
    cut = seconds.select("*", own.alias("_own"), F.explode(next_too).alias("_slice"))
    w = Window.partitionBy("_at.d", "_slice").orderBy("_at.t")
    before = lambda s: F.coalesce(F.sum("_n").over(w.rangeBetween(-(s - 1), -1)), F.lit(0))
    counts = cut.withColumns({"_minute": before(60), "_hour": before(HOUR)}).where("_own <=> _slice").select("_at", "_minute", "_hour")
    out = rows.join(counts, "_at", "left")
    return out.withColumns({"minute_count": F.col("_minute") + F.col("_nth"), "hour_count": F.col("_hour") + F.col("_nth")}).select(*df.columns, "minute_count", "hour_count")


def with_rates_by_arrival(df: DataFrame, device: str = "device_id", ts: str = "timestamp", seq: str = "seq") -> DataFrame:
    """As ``with_rates`` where times may fall: arrivals before a row that lie after its minute or hour began, at any later time too.

    A row drops all arrivals before its hour for good, so an arrival counts while no row since it, itself included, came an
    hour or more later. Going back from the row, the greatest time so far says so. The device's times so far are one array.
    """
    w = Window.partitionBy(device).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    now = F.col(ts).cast("double")
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0).alias("m"), F.lit(0).alias("h"))

    def step(a: Column, x: Column) -> Column:
        top = F.greatest(a["top"], x)
        kept = x > top - 3600
        return F.struct(top.alias("top"), (a["m"] + (kept & (x > F.col("_now") - 60)).cast("int")).alias("m"), (a["h"] + kept.cast("int")).alias("h"))

    df = df.withColumns({"_now": now, "_times": F.collect_list(now).over(w)}).withColumn("_c", F.aggregate(F.reverse("_times"), start, step))
    return df.withColumns({"minute_count": F.col("_c.m").cast("long"), "hour_count": F.col("_c.h").cast("long")}).drop("_now", "_times", "_c")


def frequency(p: Params = DEFAULT) -> Column:
    m, h = F.col("minute_count"), F.col("hour_count")
    by_minute = anomaly("high_frequency_minute", F.format_string("设备每分钟上报次数异常: %d次", m), 0.7, count=m, threshold=F.lit(p.per_minute))
    by_hour = anomaly("high_frequency_hour", F.format_string("设备每小时上报次数异常: %d次", h), 0.5, count=h, threshold=F.lit(p.per_hour))
    return F.when(m > p.per_minute, by_minute).when(h > p.per_hour, by_hour)


def with_previous(df: DataFrame, device: str = "device_id", ts: str = "timestamp", order: tuple[str, ...] = ("seq",), block: int | None = None) -> DataFrame:
    """Adds the device's previous valid position (``prev_lat``, ``prev_lon``, ``prev_ts``) and ``step_km``, ``step_seconds``, ``step_kmh``.

    Only valid positions count and get steps; rows without a device get none. A device's rows are taken in blocks of the first
    order column (of ``block`` units: arrivals, or seconds of time); a block gives on its last valid position, which the next
    ones with rows carry over, so a device with very many rows is spread over its blocks.
    """
    block = block or (SEQ_BLOCK if order[0] == "seq" else SLICE)
    ok = geo.is_valid(F.col("latitude"), F.col("longitude")) & (F.coalesce(F.col(device).cast("string"), F.lit("")) != "")
    place = F.struct("latitude", "longitude", F.col(ts).cast("double").alias("ts"))
    rows = df.withColumns({"_d": F.when(ok, F.col(device)), "_b": F.floor(F.col(order[0]).cast("double") / block), "_ok": ok})
    # rows that neither get nor give a position need not meet the others: they are dealt by their order
    apart = F.when(F.col("_ok"), F.lit(-1)).otherwise(F.pmod(F.xxhash64(*order), F.lit(1024)).cast("int"))
    rows = rows.withColumn("_apart", apart)
    inside = F.last(F.when(F.col("_ok"), place), ignorenulls=True).over(Window.partitionBy("_d", "_apart", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_p", F.when(F.col("_ok"), inside))
    ends = rows.where("_ok").groupBy("_d", "_b").agg(F.max_by(place, F.struct(*order)).alias("_end"))
    carried = F.last("_end").over(Window.partitionBy("_d").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.struct("_d", "_b").alias("_key"), carried.alias("_carried"))
    rows = rows.withColumn("_key", F.struct("_d", "_b")).join(ends, "_key", "left")
    rows = rows.withColumn("_p", F.when(F.col("_ok"), F.coalesce("_p", "_carried")))
    rows = rows.withColumns({"prev_lat": F.col("_p.latitude"), "prev_lon": F.col("_p.longitude"), "prev_ts": F.col("_p.ts")})
    df = rows.select(*df.columns, "prev_lat", "prev_lon", "prev_ts")
    km = geo.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("latitude"), F.col("longitude"))
    df = df.withColumns({"step_km": km, "step_seconds": F.abs(F.col(ts).cast("double") - F.col("prev_ts"))})
    return df.withColumn("step_kmh", F.when(F.col("prev_ts").isNotNull(), geo.speed_kmh(F.col("step_km"), F.col("step_seconds"))))


def movement(p: Params = DEFAULT) -> Column:
    km, s, v = F.col("step_km"), F.col("step_seconds"), F.col("step_kmh")
    jump = anomaly("teleport", F.format_string("检测到瞬移: %.1f公里/%.0f秒", km, s), 0.9, distance_km=km, time_seconds=s, speed_kmh=v)
    fast = anomaly("excessive_speed", F.format_string("移动速度异常: %.1fkm/h", v), 0.6, speed_kmh=v, threshold=F.lit(p.max_speed_kmh))
    return F.when(geo.is_teleport(km, s, p), jump).when(v > p.max_speed_kmh, fast)


def analyze(df: DataFrame, p: Params = DEFAULT, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Adds ``geo_anomalies`` and ``geo_score``: validity, range, rate and movement, in that order."""
    df = with_previous(with_rates(df), order=order)
    lat, lon = F.col("latitude"), F.col("longitude")
    found = F.array_compact(F.array(invalid_coordinate(lat, lon), out_of_range(lat, lon, p), frequency(p), movement(p)))
    df = df.withColumn("geo_anomalies", found)
    return df.withColumn("geo_score", scoring.union(F.transform("geo_anomalies", lambda a: a["severity"])))


def analyze_trajectory(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The same with the device's rows in the order of time."""
    return analyze(df, p, order=("timestamp", "seq"))


def jumps(coordinates: Column, timestamps: Column, p: Params = DEFAULT) -> Column:
    """Consecutive jumps of a trajectory held in arrays: structs (index, distance, time_diff, speed); the time difference is signed and a speed over no time is null."""
    at = F.when(F.size(coordinates) > 1, F.sequence(F.lit(1), F.size(coordinates) - 1)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        a, b = F.get(coordinates, i - 1), F.get(coordinates, i)
        km = geo.haversine_km(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1)))
        dt = F.get(timestamps, i) - F.get(timestamps, i - 1)
        return F.struct(i.alias("index"), km.alias("distance"), dt.alias("time_diff"), F.when(dt != 0, km / (dt / 3600)).alias("speed"))

    return F.filter(F.transform(at, one), lambda s: (s["distance"] > p.teleport_km) & (s["time_diff"] < p.teleport_seconds))
