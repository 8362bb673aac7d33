"""Cleaning of names, addresses, coordinates, phones, hours and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions import geo, hashing
from fieldtrust.functions import text as tx
from fieldtrust.params import DEFAULT, Params

# fixed values: marketing claims in names, and sentence templates
NAME_CLAIMS = ("(?:全网|全国|世界|全球)(?:第一|最好|最大|最强|最优惠)", "(?:顶级|极致|完美|绝佳)", "(?:免费|赠送|优惠|折扣).{0,5}(?:活动|促销)")
SENTENCE_TEMPLATES = (".{5,}，.{5,}，.{5,}。", "必去！.{3,}推荐！", "强烈推荐.{3,}绝对.{3,}")
MUNICIPALITIES = "(北京市|上海市|天津市|重庆市)"


def clean_name(name: Column) -> Column:
    """Struct (name, warnings): special characters out, spaces squeezed; an empty name stays as it is."""
    t = F.trim(tx.text_of(name))
    claims = F.array_compact(F.array(*[F.when(t.rlike(x), F.concat(F.lit("检测到营销词汇: "), F.regexp_extract(t, x, 0))) for x in NAME_CLAIMS]))
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(t, r"[【】《》\[\]{}|\\/@#$%^&*()_=+<>?]", ""), r"(?U)\s+", " "))
    return F.struct(F.when(t == "", name).otherwise(cleaned).alias("name"), F.when(t == "", F.array(F.lit("名称为空"))).otherwise(claims).alias("warnings"))


def split_address(address: Column) -> Column:
    """Struct (province, city, district, street, number, full_address, confidence) by greedy patterns: a city is all up to the last 市, and so on."""
    t = F.trim(tx.text_of(address))
    first = lambda *ps: F.coalesce(*[F.nullif(F.regexp_extract(t, x, 1), F.lit("")) for x in ps], F.lit(""))
    province = first(MUNICIPALITIES, "(.+省)")
    city = first("(.+市)", "(.+自治州)")
    city = F.when(city == province, "").otherwise(city)
    district = first("(.+区)", "(.+县)", "(.+市)")
    district = F.when((district == province) | (district == city), "").otherwise(district)
    street, number = first("(.+路|.+街|.+道|.+巷)"), first(r"(\d+号)")
    parts = ((province, 0.3), (city, 0.2), (district, 0.2), (street, 0.2), (number, 0.1))
    sure = sum((F.when(c != "", w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    whole = F.when(t == "", address).otherwise(F.trim(F.concat(*[c for c, _ in parts])))
    return F.struct(*[c.alias(n) for (c, _), n in zip(parts, ("province", "city", "district", "street", "number"), strict=True)], whole.alias("full_address"), sure.alias("confidence"))


def preprocess(df: DataFrame) -> DataFrame:
    """Rows with ``name, address, latitude, longitude, phone, business_hours`` (those that there are) to cleaned columns, ``is_valid``, ``errors``, ``warnings``, ``dedup_key``."""
    have = set(df.columns)
    out, warn, errors = {}, [], []
    if "name" in have:
        n = clean_name(F.col("name"))
        out["name"] = tx.strip_noise(n["name"])
        warn.append(n["warnings"])
    if "address" in have:
        a = split_address(F.col("address"))
        out["address"], out["address_parts"] = tx.strip_noise(a["full_address"]), a
        warn.append(F.when(a["confidence"] < 0.5, F.array(F.concat(F.lit("地址标准化置信度较低: "), a["confidence"].cast("string")))))
    if {"latitude", "longitude"} <= have:
        c = geo.coordinate_error(F.col("latitude"), F.col("longitude"))
        out["latitude"], out["longitude"] = c["latitude"], c["longitude"]
        errors.append(F.when(~c["valid"], F.array(c["error"])))
    if "phone" in have:
        ph = tx.phone(F.col("phone"))
        out["phone"] = tx.strip_noise(ph["phone"])
        warn.append(F.when(~ph["valid"], F.array(F.concat(F.lit("电话格式异常: "), F.col("phone")))))
    if "business_hours" in have:
        h = tx.business_hours(F.col("business_hours"))
        warn.append(F.when(~h["valid"], F.array(F.concat(F.lit("营业时间逻辑异常: "), h["error"]))))
    none = F.array().cast("array<string>")
    joined = lambda xs: F.concat(none, *[F.coalesce(x, none) for x in xs])
    flags = {"warnings": joined(warn), "errors": joined(errors)}
    df = df.withColumns(flags | {f"_{k}": v for k, v in out.items()})
    if {"name", "address"} <= have:
        df = df.withColumn("dedup_key", hashing.dedup_key(clean_name(F.col("name"))["name"], split_address(F.col("address"))["full_address"]))
    return df.withColumn("is_valid", F.size("errors") == 0).drop(*[k for k in out if k in have]).withColumnsRenamed({f"_{k}": k for k in out})


def clean_text(text: Column, p: Params = DEFAULT) -> Column:
    """Struct (text, is_valid, removed, warnings): white space and odd characters out, cut to length, runs of four and repeated sentences to one.

    The full-width comma, exclamation and question mark are made plain first and then dropped with all that is not listed,
    so sentences are only ever told apart by what is left; the number removed is taken before repeats are.
    """
    raw = tx.text_of(text)
    kept = F.regexp_replace(tx.normalize(raw), '[^一-龥a-zA-Z0-9，。！？、；："（）【】\\-+.]', "")
    cut = F.when(F.length(kept) < p.min_length, "").otherwise(F.substring(kept, 1, p.max_length))
    stuffed = cut.rlike("(?:" + "|".join(p.keywords[:5]) + "){3,}")
    hits = F.size(tx.matched(cut, p.keywords))
    words = F.regexp_count(cut, F.lit(r"(?U)\w+"))
    stuffed = stuffed | ((words > 0) & (hits / words > 0.3))
    template = F.lit(False)
    for x in SENTENCE_TEMPLATES:
        template = template | cut.rlike(f"^(?:{x})$")
    said = F.array_compact(F.array(F.when(stuffed, "检测到营销词堆砌"), F.when(template, "检测到模板化内容"), F.when(hits >= 3, F.format_string("包含%d个可疑关键词", hits))))
    single = F.regexp_replace(cut, r"(.)\1{3,}", "$1")
    parts = F.array_distinct(F.filter(F.transform(F.split(single, "[。！？]"), F.trim), lambda s: s != ""))
    done = F.array_join(parts, "。")
    return F.struct(done.alias("text"), (F.length(done) >= p.min_length).alias("is_valid"), (F.length(raw) - F.length(cut)).alias("removed"), said.alias("warnings"))


def validate_poi(df: DataFrame) -> DataFrame:
    """Adds ``errors`` and ``warnings`` of a place's name, coordinates, address and phone."""
    name, address = F.trim(tx.text_of(F.col("name"))), tx.text_of(F.col("address"))
    lat, lon = (F.col(c).cast("string").try_cast("double") for c in ("latitude", "longitude"))
    gone = F.col("latitude").isNull() | F.col("longitude").isNull()
    errors = F.array(
        F.when(name == "", "name_missing").when(F.length(name) < 2, "name_too_short").when(F.length(name) > 100, "name_too_long"),
        F.when(~gone & (lat.isNull() | lon.isNull()), "coordinate_format"),
        F.when(~lat.between(-90, 90), "latitude_range"),
        F.when(~lon.between(-180, 180), "longitude_range"),
    )
    plain = r"^1[3-9]\d{9}$|^0\d{2,3}-?\d{7,8}$|^400-?\d{3}-?\d{4}$"
    warnings = F.array(F.when(F.length(address) > 200, "address_too_long"), F.when((tx.text_of(F.col("phone")) != "") & ~F.col("phone").rlike(plain), "phone_format"))
    return df.withColumns({"errors": F.array_compact(errors), "warnings": F.array_compact(warnings)})


def correct_coordinates(lat: Column, lon: Column, system: str = "wgs84") -> Column:
    """The simple variant: struct (latitude, longitude, correction, is_valid, warnings); a shifted datum is taken back by the linear shift."""
    from fieldtrust.operators.spatial import in_simple_water

    x, y = geo.linear_shift(lat, lon, -1) if system == "gcj02" else (lat, lon)
    moved = F.lit(system == "gcj02") & geo.is_valid(x, y)
    la, lo = F.when(moved, x).otherwise(lat), F.when(moved, y).otherwise(lon)
    digits = F.least(geo.decimals(la), geo.decimals(lo)) * 111000.0
    said = F.array_compact(F.array(F.when(in_simple_water(la, lo), "坐标可能在水域或禁区"), F.when(digits < 0.00001, "坐标精度过高，可能存在异常")))
    return F.struct(F.when(moved, x).alias("latitude"), F.when(moved, y).alias("longitude"), F.when(moved, "gcj02_to_wgs84").alias("correction"), geo.is_valid(lat, lon).alias("is_valid"), said.alias("warnings"))


def quarantine(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that hold, rows that don't); null doesn't hold."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(ok), df.where(~ok)


def request_is_valid() -> Column:
    """The domain of a request: coordinates in range, a text of 1 to 5000 characters, a time that isn't negative."""
    n = F.length(F.col("content.text"))
    return geo.is_valid(F.col("geo.latitude"), F.col("geo.longitude")) & n.between(1, 5000) & (F.col("timestamp") >= 0)
