"""Coordinates as column expressions: distance, speed, validity, datum shifts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtrust.params import DEFAULT, Params

EARTH_KM = 6371.0
# fixed values: the ellipsoid of the shifted datum and the box where the shift applies
AXIS, ECCENTRICITY = 6378245.0, 0.00669342162296594323
SHIFT_BOX = {"lat": (0.8293, 55.8271), "lon": (72.004, 137.8347)}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the root's argument is kept at 1 at most."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000


def is_valid(lat: Column, lon: Column) -> Column:
    """Within +-90 and +-180; NaN and null are invalid."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def in_country(lat: Column, lon: Column, p: Params = DEFAULT) -> Column:
    return lat.between(p.lat_min, p.lat_max) & lon.between(p.lon_min, p.lon_max)


def speed_kmh(distance_km: Column, seconds: Column) -> Column:
    """Speed over an absolute time difference; no time and some way is infinite, no way is 0."""
    dt = F.abs(F.coalesce(seconds, F.lit(0.0)))
    return F.when(dt == 0, F.when(distance_km > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(distance_km / (dt / 3600))


def is_teleport(distance_km: Column, seconds: Column, p: Params = DEFAULT) -> Column:
    return (distance_km > p.teleport_km) & (F.abs(seconds) < p.teleport_seconds)


def _waves(terms: list[tuple[float, Column]]) -> Column:
    total = F.lit(0.0)
    for size, angle in terms:
        total = total + F.lit(size) * F.sin(angle * math.pi)
    return total * (2.0 / 3.0)


def _shift(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The shifted datum's offset in degrees at a point."""
    x, y = lon - 105.0, lat - 35.0
    ripple = [(20.0, x * 6.0), (20.0, x * 2.0)]
    north = -100.0 + x * 2.0 + y * 3.0 + y * y * 0.2 + x * y * 0.1 + F.sqrt(F.abs(x)) * 0.2
    north = north + _waves([*ripple, (20.0, y), (40.0, y / 3.0), (160.0, y / 12.0), (320.0, y / 30.0)])
    east = 300.0 + x + y * 2.0 + x * x * 0.1 + x * y * 0.1 + F.sqrt(F.abs(x)) * 0.1
    east = east + _waves([*ripple, (20.0, x), (40.0, x / 3.0), (150.0, x / 12.0), (300.0, x / 30.0)])
    w = 1 - ECCENTRICITY * F.pow(F.sin(F.radians(lat)), 2)
    meridian = F.lit(AXIS * (1 - ECCENTRICITY)) / (w * F.sqrt(w))
    normal = F.lit(AXIS) / F.sqrt(w) * F.cos(F.radians(lat))
    return F.degrees(north / meridian), F.degrees(east / normal)


def outside_shift(lat: Column, lon: Column) -> Column:
    return ~(lat.between(*SHIFT_BOX["lat"]) & lon.between(*SHIFT_BOX["lon"]))


def wgs84_to_gcj02(lat: Column, lon: Column) -> tuple[Column, Column]:
    dlat, dlon = _shift(lat, lon)
    out = outside_shift(lat, lon)
    return F.when(out, lat).otherwise(lat + dlat), F.when(out, lon).otherwise(lon + dlon)


def gcj02_to_wgs84(lat: Column, lon: Column) -> tuple[Column, Column]:
    """First-order inverse: the offset at the shifted point is taken off."""
    dlat, dlon = _shift(lat, lon)
    out = outside_shift(lat, lon)
    return F.when(out, lat).otherwise(lat - dlat), F.when(out, lon).otherwise(lon - dlon)


def _polar(x: Column, y: Column, sign: int) -> tuple[Column, Column]:
    turn = math.pi * 3000.0 / 180.0
    r = F.sqrt(x * x + y * y) + sign * 0.00002 * F.sin(y * turn)
    a = F.atan2(y, x) + sign * 0.000003 * F.cos(x * turn)
    return r * F.cos(a), r * F.sin(a)


def gcj02_to_bd09(lat: Column, lon: Column) -> tuple[Column, Column]:
    x, y = _polar(lon, lat, 1)
    return y + 0.006, x + 0.0065


def bd09_to_gcj02(lat: Column, lon: Column) -> tuple[Column, Column]:
    x, y = _polar(lon - 0.0065, lat - 0.006, -1)
    return y, x


def convert(lat: Column, lon: Column, source: str, target: str) -> tuple[Column, Column]:
    """Between ``wgs84``, ``gcj02`` and ``bd09``, by way of WGS84."""
    if source == target:
        return lat, lon
    if source == "bd09":
        lat, lon = bd09_to_gcj02(lat, lon)
    if source != "wgs84":
        lat, lon = gcj02_to_wgs84(lat, lon)
    if target != "wgs84":
        lat, lon = wgs84_to_gcj02(lat, lon)
    return gcj02_to_bd09(lat, lon) if target == "bd09" else (lat, lon)


def linear_shift(lat: Column, lon: Column, sign: int) -> tuple[Column, Column]:
    """The simple variant: a hundred-thousandth of the way from (35, 105)."""
    return lat + (lat - 35.0) * (sign * 0.00001), lon + (lon - 105.0) * (sign * 0.00001)


def decimals(x: Column) -> Column:
    """Digits after the point of the shortest decimal form."""
    s = x.cast("double").cast("string")
    return F.when(F.instr(s, ".") > 0, F.length(F.substring_index(s, ".", -1))).otherwise(0)


def precision(lat: Column, lon: Column) -> Column:
    """Precision verdict: digits times 111,000, so that any fraction counts as low."""
    a = decimals(lat) * 111000.0
    b = decimals(lon) * 111000.0 * F.cos(F.radians(lat))
    level = F.when((a < 1) & (b < 1), "very_high").when((a < 10) & (b < 10), "high").when((a < 100) & (b < 100), "medium").otherwise("low")
    return F.struct(level.alias("level"), a.alias("lat_meters"), b.alias("lon_meters"))


def coordinate_error(lat: Column, lon: Column, p: Params = DEFAULT) -> Column:
    """Struct (valid, latitude, longitude, error) of coordinates given as text or numbers."""
    x, y = lat.cast("string").try_cast("double"), lon.cast("string").try_cast("double")
    error = (
        F.when(x.isNull() | y.isNull(), "坐标格式错误")
        .when((x < -90) | (x > 90), F.concat(F.lit("纬度超出范围: "), x.cast("string")))
        .when((y < -180) | (y > 180), F.concat(F.lit("经度超出范围: "), y.cast("string")))
        .when(~in_country(x, y, p), "坐标不在中国境内")
    )
    valid = x.isNotNull() & y.isNotNull() & ~((x < -90) | (x > 90) | (y < -180) | (y > 180))
    return F.struct(valid.alias("valid"), x.alias("latitude"), y.alias("longitude"), error.alias("error"))
