"""Synthetic records, the same on every run for one seed and in any partitioning: values are hashes of (seed, row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.operators.spatial import CITIES

NORMAL = ("味道一般，环境还可以，服务员态度不错。", "周末和家人来的，停车方便，菜量适中。", "路过进来看看，东西不多但挺干净。", "排了十分钟队，整体感觉还行。")
HYPE = ("超级推荐！！！必去必买，绝绝子！", "全网第一，最好最强，限时优惠，手慢无！", "yyds宝藏店铺，强烈推荐，网红打卡胜地！")


def unit(seed: int, *what: Column | str) -> Column:
    """A number in [0, 1) from the row's id and a purpose."""
    return F.pmod(F.xxhash64(F.lit(seed), "id", *[F.lit(w) if isinstance(w, str) else w for w in what]), F.lit(1 << 30)) / float(1 << 30)


def pick(options: tuple, u: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.floor(u * len(options)).cast("int"))


def records(spark: SparkSession, normal: int, fake: int, geo_share: float = 0.5, seed: int = 42, start: int = 1_700_000_000) -> DataFrame:
    """Normal rows near a city with plain texts; fakes with a bad place or a hyped text."""
    df = spark.range(normal + fake)
    is_fake = F.col("id") >= normal
    bad_place = is_fake & (unit(seed, "kind") < geo_share)
    city = F.floor(unit(seed, "city") * len(CITIES)).cast("int")
    at = lambda k: F.get(F.array(*[F.lit(c[k]) for c in CITIES]), city)
    return df.select(
        F.format_string("R%08d", "id").alias("record_id"), F.format_string("dev_%d", F.floor(unit(seed, "device") * (normal + fake) / 3).cast("long")).alias("device_id"),
        F.format_string("user_%d", F.col("id") % 97).alias("user_id"), (F.lit(start) + F.col("id") * 60).cast("double").alias("timestamp"),
        F.when(bad_place, 95 + unit(seed, "lat") * 100).otherwise(at(1) + (unit(seed, "lat") - 0.5) / 10).alias("latitude"),
        F.when(bad_place, 190 + unit(seed, "lon") * 100).otherwise(at(2) + (unit(seed, "lon") - 0.5) / 10).alias("longitude"),
        F.when(is_fake & ~bad_place, pick(HYPE, unit(seed, "text"))).otherwise(pick(NORMAL, unit(seed, "text"))).alias("text"),
        F.when(is_fake, "fake").otherwise("normal").alias("label"), F.col("id").alias("seq"),
    )


def teleports(spark: SparkSession, pairs: int, start: int = 1_700_000_000) -> DataFrame:
    """Pairs of reports of one device from two cities half a minute apart."""
    a, b = CITIES[0], CITIES[1]
    first = F.col("id") % 2 == 0
    return spark.range(2 * pairs).select(
        F.format_string("T%06d", "id").alias("record_id"), F.format_string("jump_%d", F.floor(F.col("id") / 2)).alias("device_id"), F.lit("user").alias("user_id"),
        (F.lit(start) + F.col("id") * 30).cast("double").alias("timestamp"), F.when(first, a[1]).otherwise(b[1]).alias("latitude"), F.when(first, a[2]).otherwise(b[2]).alias("longitude"),
        F.lit(NORMAL[0]).alias("text"), F.lit("fake").alias("label"), F.col("id").alias("seq"),
    )


def similar_batch(spark: SparkSession, n: int, start: int = 1_700_000_000) -> DataFrame:
    """Nearly equal texts from one place, ten seconds apart."""
    return spark.range(n).select(
        F.format_string("S%06d", "id").alias("record_id"), F.format_string("dev_%d", "id").alias("device_id"), F.lit("user").alias("user_id"), (F.lit(start) + F.col("id") * 10).cast("double").alias("timestamp"),
        F.lit(CITIES[0][1]).alias("latitude"), F.lit(CITIES[0][2]).alias("longitude"), F.concat(F.lit("这家店真的很不错，推荐大家都来试试，环境好服务好味道好"), F.col("id") % 3).alias("text"), F.lit("fake").alias("label"), F.col("id").alias("seq"),
    )


def training(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Five strata: 60 % normal, 16 % hype, 8 % bad places, 8 % both, 8 % on the border (ordinary places with one hyped word)."""
    base = records(spark, n, 0, seed=seed).withColumn("id", F.col("seq"))
    u = unit(seed, "stratum")
    stratum = F.when(u < 0.60, "normal").when(u < 0.76, "marketing").when(u < 0.84, "geo").when(u < 0.92, "mixed").otherwise("boundary")
    s = base.withColumn("stratum", stratum)
    hype, place = F.col("stratum").isin("marketing", "mixed"), F.col("stratum").isin("geo", "mixed")
    text = F.when(hype, pick(HYPE, unit(seed, "hype"))).when(F.col("stratum") == "boundary", F.concat(F.col("text"), F.lit("打卡"))).otherwise(F.col("text"))
    out = s.withColumns({"text": text, "latitude": F.when(place, F.lit(45.0)).otherwise(F.col("latitude")), "longitude": F.when(place, F.lit(-100.0)).otherwise(F.col("longitude"))})
    return out.withColumn("label", F.when(hype | place, "fake").otherwise("normal")).drop("id")


# fixed values: sample places, plain and made up
PLACES = (("星巴克(三里屯店)", "北京市朝阳区三里屯路19号", "餐饮"), ("麦当劳(国贸店)", "北京市朝阳区建国门外大街1号", "餐饮"), ("肯德基(王府井店)", "北京市东城区王府井大街138号", "餐饮"), ("全聚德(前门店)", "北京市东城区前门大街30号", "餐饮"), ("海底捞(望京店)", "北京市朝阳区望京西路甲50号", "餐饮"))
FAKE_PLACES = (("全网第一网红奶茶店", "北京市朝阳区某某路123号", "餐饮"), ("顶级spa会所", "北京市海淀区某某街456号", "休闲"), ("免费体验中心", "北京市西城区某某巷789号", "服务"))


def places(spark: SparkSession, n: int = 10, include_fake: bool = True, seed: int = 42, start: int = 1_700_000_000) -> DataFrame:
    """Sample places around one centre; the first three are made up where fakes are asked for."""
    fake = (F.col("id") < 3) & F.lit(include_fake)
    u = unit(seed, "place")
    part = lambda k: F.when(fake, pick(tuple(p[k] for p in FAKE_PLACES), u)).otherwise(pick(tuple(p[k] for p in PLACES), u))
    text = F.concat(F.lit("这是"), part(0), F.lit("的描述信息"))
    return spark.range(n).select(
        F.format_string("P%08d", "id").alias("record_id"), F.format_string("D_SAMPLE_%d", "id").alias("device_id"), F.format_string("U_SAMPLE_%d", "id").alias("user_id"), (F.lit(start) + F.col("id")).cast("double").alias("timestamp"),
        part(0).alias("name"), part(1).alias("address"), part(2).alias("category"), F.round(39.9 + (unit(seed, "lat") - 0.5) / 5, 6).alias("latitude"), F.round(116.4 + (unit(seed, "lon") - 0.5) / 5, 6).alias("longitude"),
        text.alias("description"), text.alias("text"), F.format_string("010-%d", F.floor(unit(seed, "phone") * 89999999).cast("long") + 10000000).alias("phone"), F.when(fake, "fake").otherwise("normal").alias("label"), F.col("id").alias("seq"),
    )


def random_matrix(spark: SparkSession, n: int = 1000, width: int = 10, seed: int = 42) -> DataFrame:
    """``(id, x, y)``: rows of uniform numbers; y is 1 where one of the first three is over 0.6."""
    x = F.array(*[unit(seed, f"x{k}") for k in range(width)])
    return spark.range(n).select("id", x.alias("x")).withColumn("y", F.exists(F.slice("x", 1, 3), lambda v: v > 0.6).cast("int"))
