"""The operators' input tables, derived from the driver's by arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.operators.layout import spread
from fieldtrust.params import Params

#: Rules for the prose of the test tables: a lexicon in its languages, thresholds that sometimes hold.
PROSE = Params(
    keywords=("worthless", "disgusting", "trash"), default_keywords=("trash", "idiot", "stupid", "scum", "moron", "loser", "License"),
    templates=("(?:disgusting|worthless|trash|idiot)", "[!]{2,}", "[*]{3,}"), min_length=20, max_length=5000,
)
#: Limits that a month of sparse events meets.
SPARSE = Params(per_minute=1, per_hour=2)
LAT, LON = "((event_id * 7919) % 20001 - 10000) / 100.0", "((event_id * 104729) % 40001 - 20000) / 100.0"
RISKS = ("low", "medium", "high")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports with a place."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("record_id"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("device_id"), F.unix_timestamp("ts").alias("timestamp"),
        F.expr(f"cast({LAT} as double)").alias("latitude"), F.expr(f"cast({LON} as double)").alias("longitude"), F.lit("").alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("record_id"), "text")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of the detection table."""
    e = F.col("event_id")
    score = lambda m: ((e * m) % 10001 / 100.0).cast("double")
    risk = F.when(e % 5 == 0, "high").when(e % 3 == 0, "medium").when(e % 11 != 0, "low")
    return read(spark, sf_dir, "events").select(
        e.alias("id"), e.alias("seq"), e.cast("string").alias("record_id"), (e % 3).alias("tenant_id"), F.col("user_id").cast("string").alias("device_id"), F.col("event_type").alias("content_type"),
        F.when(e % 4 > 0, "GPS").alias("geo_source"), (e % 7 == 0).alias("is_fake"), risk.alias("risk_level"), score(37).alias("suspicion_score"),
        F.when(e % 2 == 0, score(41)).otherwise(0.0).alias("geo_score"), F.when(e % 3 == 0, score(43)).otherwise(0.0).alias("text_score"), F.when(e % 5 == 0, score(47)).otherwise(0.0).alias("simhash_score"),
        F.when(e % 7 == 0, score(53)).otherwise(0.0).alias("semantic_score"), F.when(e % 6 == 0, "pending").otherwise("approved").alias("review_status"),
        (e % 900).cast("int").alias("processing_time_ms"), F.col("ts").alias("created_at"), F.col("props").alias("text"),
        F.array_compact(F.array(F.when(e % 2 == 0, "geo"), F.when(e % 3 == 0, "text"), F.when(e % 5 == 0, "copy"))).alias("reasons"),
    )


#: The detection table in SQL.
DETECTIONS_SQL = """(SELECT event_id AS id, event_id % 3 AS tenant_id, CAST(user_id AS VARCHAR) AS device_id, event_type AS content_type, CASE WHEN event_id % 4 > 0 THEN 'GPS' END AS geo_source,
  event_id % 7 = 0 AS is_fake, CASE WHEN event_id % 5 = 0 THEN 'high' WHEN event_id % 3 = 0 THEN 'medium' WHEN event_id % 11 <> 0 THEN 'low' END AS risk_level,
  (event_id * 37) % 10001 / 100.0 AS suspicion_score, CASE WHEN event_id % 2 = 0 THEN (event_id * 41) % 10001 / 100.0 ELSE 0 END AS geo_score,
  CASE WHEN event_id % 3 = 0 THEN (event_id * 43) % 10001 / 100.0 ELSE 0 END AS text_score, CASE WHEN event_id % 5 = 0 THEN (event_id * 47) % 10001 / 100.0 ELSE 0 END AS simhash_score,
  CASE WHEN event_id % 7 = 0 THEN (event_id * 53) % 10001 / 100.0 ELSE 0 END AS semantic_score, CASE WHEN event_id % 6 = 0 THEN 'pending' ELSE 'approved' END AS review_status,
  event_id % 900 AS processing_time_ms, ts AS created_at, props AS text FROM events)"""
REPORTS_SQL = f"""(SELECT event_id AS seq, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST({LAT} AS DOUBLE) AS lat, CAST({LON} AS DOUBLE) AS lon FROM events)"""
