"""Rollup tables that are kept up to date by increments.

An increment is reduced to sums and counts by tenant and day (or hour), which add up over increments, and written to partitions of
its own, (stat_date, increment): done again, it overwrites itself. Then the days that it touched, late ones too, are added up from
all increments and written over the rollup table by dynamic partition overwrite; no other day is read or written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The measures of a rollup row; averages come from sums.
COUNTS = (
    "total_records", "fake_records", "normal_records", "pending_records", "high_risk_count", "medium_risk_count", "low_risk_count", "geo_anomaly_count", "text_anomaly_count",
    "duplicate_count", "cluster_anomaly_count", "api_calls", "api_errors", "review_count", "review_approved", "review_rejected",
)
SUMS = ("score_sum", "score_n", "ms_sum", "ms_n")
UNITS = {"day": "stat_date", "hour": "stat_time"}


def _bucket(unit: str) -> Column:
    return F.to_date("created_at") if unit == "day" else F.date_trunc(unit, "created_at")


def partials(detections: DataFrame | None, calls: DataFrame | None = None, unit: str = "day") -> DataFrame:
    """(tenant_id, bucket, counts and sums) of ``detections`` and of ``calls(tenant_id, created_at, status)``: one aggregation each, added up; either may be missing."""
    key = UNITS[unit]
    risk = lambda k: F.count_if(F.col("risk_level") == k)
    hit = lambda k: F.count_if(F.col(f"{k}_score") > 0)
    review = lambda *k: F.count_if(F.col("review_status").isin(*k))
    zero = F.lit(0).cast("long")
    parts = []
    if detections is not None:
        made = {
            "total_records": F.count("*"), "fake_records": F.count_if("is_fake"), "normal_records": F.count_if(~F.col("is_fake")), "pending_records": review("pending"),
            "high_risk_count": risk("high"), "medium_risk_count": risk("medium"), "low_risk_count": risk("low"), "geo_anomaly_count": hit("geo"), "text_anomaly_count": hit("text"),
            "duplicate_count": hit("simhash"), "cluster_anomaly_count": hit("semantic"), "review_count": review("approved", "rejected"), "review_approved": review("approved"), "review_rejected": review("rejected"),
            # decimals: sums of them do not hang on the order of adding
            "score_sum": F.sum(F.col("suspicion_score").cast("decimal(18,6)")), "score_n": F.count("suspicion_score"), "ms_sum": F.sum(F.col("processing_time_ms").cast("long")), "ms_n": F.count("processing_time_ms"),
        }
        d = detections.groupBy("tenant_id", _bucket(unit).alias(key)).agg(*[v.alias(k) for k, v in made.items()])
        parts.append(d.withColumns({"api_calls": zero, "api_errors": zero}))
    if calls is not None:
        c = calls.groupBy("tenant_id", _bucket(unit).alias(key)).agg(F.count("*").alias("api_calls"), F.count_if(F.col("status") >= 400).alias("api_errors"))
        parts.append(c.withColumns({k: zero for k in (*COUNTS, *SUMS) if k not in ("api_calls", "api_errors")}))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return merged(out, unit)


def merged(df: DataFrame, unit: str = "day") -> DataFrame:
    """Partial rows of equal tenant and bucket added up."""
    kinds = {"score_sum": "decimal(28,6)"}
    return df.groupBy("tenant_id", UNITS[unit]).agg(*[F.coalesce(F.sum(k), F.lit(0)).cast(kinds.get(k, "long")).alias(k) for k in (*COUNTS, *SUMS)])


def finished(df: DataFrame) -> DataFrame:
    """Averages in place of their sums; null where there is nothing to average."""
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s).cast("double") / F.col(n))
    return df.withColumns({"avg_suspicion_score": mean("score_sum", "score_n"), "avg_processing_time_ms": mean("ms_sum", "ms_n")}).drop(*SUMS)


def apply_increment(path: str, increment: str, detections: DataFrame | None, calls: DataFrame | None = None, unit: str = "day") -> None:
    """Bring the rollup under ``path`` up to date by the rows of one increment, which ``increment`` names; doing it again changes nothing."""
    key = UNITS[unit]
    new = partials(detections, calls, unit)
    spark = new.sparkSession
    new = new.withColumns({"_day": F.to_date(key), "_increment": F.lit(increment)})
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day", "_increment").parquet(f"{path}/partials")
    every = spark.read.schema(new.schema).parquet(f"{path}/partials")
    days = every.where(F.col("_increment") == increment).select("_day").distinct()
    touched = every.join(F.broadcast(days), "_day", "left_semi")  # a day a row; only partitions of these days are read
    out = finished(merged(touched.drop("_day", "_increment"), unit)).withColumn("_day", F.to_date(key))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day").parquet(f"{path}/{unit}")


def rollup(spark: SparkSession, path: str, unit: str = "day") -> DataFrame:
    """The rollup table as it stands."""
    return spark.read.parquet(f"{path}/{unit}").drop("_day")
