"""Filtering, paging and shaping of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtrust.functions.text import shorten
from fieldtrust.operators.layout import running_count


def filtered(df: DataFrame, equal: dict | None = None, since: str | None = None, until: str | None = None, keyword: str | None = None, tenant: int | None = None, keyword_column: str = "text", time: str = "created_at") -> DataFrame:
    """All given conditions: equality (None is not asked), a closed time range, a keyword anywhere, case aside. Equality and range reach the scan."""
    if tenant is not None:
        df = df.where(F.col("tenant_id") == tenant)
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if since is not None:
        df = df.where(F.col(time) >= F.to_timestamp(F.lit(since)))
    if until is not None:
        df = df.where(F.col(time) <= F.to_timestamp(F.lit(until)))
    return df if keyword is None else df.where(F.contains(F.lower(F.col(keyword_column)), F.lower(F.lit(keyword))))


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))


def review_queue(df: DataFrame, risk: str | None = None) -> DataFrame:
    rows = filtered(df, {"review_status": "pending", "risk_level": risk})
    return rows.select("id", "record_id", "risk_level", "suspicion_score", F.slice("reasons", 1, 3).alias("reasons"), F.substring("text", 1, 200).alias("text")).orderBy(F.col("suspicion_score").desc(), "id")


def listing(df: DataFrame) -> DataFrame:
    return df.withColumn("text", shorten(F.col("text")))


def normalized(df: DataFrame) -> DataFrame:
    """Flat or nested records to flat ones: a flat value goes before a nested one; absent numbers are 0, absent texts empty."""
    have = set(df.columns)
    kinds = dict(df.dtypes)

    def of(flat: str, nested: str | None, kind: str, default) -> Column:
        options = [F.col(flat)] if flat in have else []
        if nested and nested.split(".")[0] in have and f"{nested.split('.')[1]}:" in kinds[nested.split(".")[0]]:
            options.append(F.col(nested))
        return F.coalesce(*[c.cast(kind) for c in options], F.lit(default).cast(kind)).alias(flat)

    ids = [F.col(c).cast("string") for c in ("record_id", "id") if c in have]
    return df.select(
        F.coalesce(*ids, F.lit("")).alias("record_id"), of("device_id", None, "string", ""), of("user_id", None, "string", ""), of("timestamp", None, "double", 0.0),
        of("latitude", "geo.latitude", "double", 0.0), of("longitude", "geo.longitude", "double", 0.0), of("accuracy", "geo.accuracy", "double", 10.0), of("source", "geo.source", "string", "GPS"),
        of("text", "content.text", "string", ""), of("content_type", "content.content_type", "string", "review"), (F.col("label") if "label" in have else F.lit(None)).cast("string").alias("label"),
        *([F.col("seq")] if "seq" in have else []),
    )


def from_file_row(df: DataFrame) -> DataFrame:
    """Text of an uploaded row: description, else text, else name; empty ones fall through."""
    options = [F.nullif(F.col(c), F.lit("")) for c in ("description", "text", "name") if c in df.columns]
    return df.withColumn("text", F.coalesce(*options, F.lit("")))


def poi(df: DataFrame, placeholder: str = "unnamed") -> DataFrame:
    return df.withColumn("name", F.coalesce(F.nullif(F.substring("text", 1, 100), F.lit("")), F.lit(placeholder)))


def last_n(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each incoming key that isn't there, blank keys left out."""
    named = incoming.where(F.coalesce(F.trim(keys[-1]), F.lit("")) != "")
    return named.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def split_known(requests: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(requests with a stored result, requests without)."""
    seen = known.select(key).distinct()
    return requests.join(seen, key, "left_semi"), requests.join(seen, key, "left_anti")


def last_wins(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """One row a key: the last by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def group_split(df: DataFrame, text: str = "text", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` so that equal normalised texts fall on one side."""
    from fieldtrust.functions.text import normalize

    h = F.pmod(F.xxhash64(F.lit(seed), F.lower(normalize(F.col(text)))), F.lit(10_000))
    return df.withColumn("is_test", h < int(test_share * 10_000))


def fixed_window_limit(df: DataFrame, key: str, ts: str, limit: int = 100, seconds: int = 60, order: str = "seq") -> DataFrame:
    """Adds ``within_limit``: the first ``limit`` requests of a key in each window of whole ``seconds``."""
    w = Window.partitionBy(key, F.floor(F.col(ts).cast("long") / seconds)).orderBy(order)
    return df.withColumn("within_limit", F.row_number().over(w) <= limit)


def quota(df: DataFrame, tenant: str, time: str, daily: int = 10_000, monthly: int = 300_000, order: str = "seq") -> DataFrame:
    """Adds the tenant's running counts of the day and the month and whether both are within their quotas; a large tenant's month is spread over many tasks."""
    df = running_count(df, [F.col(tenant), F.to_date(time)], order, "day_count")
    df = running_count(df, [F.col(tenant), F.date_trunc("month", time)], order, "month_count")
    return df.withColumn("within_quota", (F.col("day_count") <= daily) & (F.col("month_count") <= monthly))


def with_tenant_params(df: DataFrame, overrides: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Joins a tenant's parameters (text values; bad ones fall back to the default). Tenants are few; Spark decides on a broadcast by size."""
    wide = overrides.groupBy("tenant_id").pivot("name", list(defaults)).agg(F.first("value"))
    out = df.join(wide, "tenant_id", "left")
    return out.withColumns({k: F.coalesce(F.col(k).try_cast("double"), F.lit(float(v))) for k, v in defaults.items()})
