"""Registered queries of tables that are kept up to date, and of metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.operators import metrics, rollups
from fieldtrust.operators.graph import checkpoint_dir
from fieldtrust.plans import tables as t
from fieldtrust.plans.registry import query, times, ts
from fieldtrust.plans.tables import DETECTIONS_SQL

_CALLS_SQL = "(SELECT event_id % 3 AS tenant_id, ts AS created_at, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events)"


def _rollup_sql(bucket: str, key: str) -> str:
    return f"""WITH d AS (SELECT tenant_id, {bucket} AS b, count(*) AS total_records, count(*) FILTER (is_fake) AS fake_records, count(*) FILTER (NOT is_fake) AS normal_records, count(*) FILTER (review_status = 'pending') AS pending_records,
count(*) FILTER (risk_level = 'high') AS high_risk_count, count(*) FILTER (risk_level = 'medium') AS medium_risk_count, count(*) FILTER (risk_level = 'low') AS low_risk_count, {ts('CAST(sum(CAST(round(suspicion_score * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) * 1000')} AS avg_score_k, {ts('avg(processing_time_ms) * 1000')} AS avg_us,
count(*) FILTER (geo_score > 0) AS geo_anomaly_count, count(*) FILTER (text_score > 0) AS text_anomaly_count, count(*) FILTER (simhash_score > 0) AS duplicate_count, count(*) FILTER (semantic_score > 0) AS cluster_anomaly_count,
count(*) FILTER (review_status IN ('approved', 'rejected')) AS review_count, count(*) FILTER (review_status = 'approved') AS review_approved, count(*) FILTER (review_status = 'rejected') AS review_rejected FROM {DETECTIONS_SQL} GROUP BY 1, 2),
c AS (SELECT tenant_id, {bucket} AS b, count(*) AS api_calls, count(*) FILTER (status >= 400) AS api_errors FROM {_CALLS_SQL} GROUP BY 1, 2)
SELECT * EXCLUDE (b), CAST(b AS VARCHAR) AS {key} FROM d JOIN c USING (tenant_id, b)"""


def _kept_up(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """The rollup after two increments, the second with late rows of every day, and the first of them done again."""
    path = f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}"
    d = t.detections(spark, sf_dir)
    calls = t.read(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("tenant_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("event_id").alias("id"))
    for name, late in (("first", False), ("late", True), ("first", False)):
        some = (F.col("id") % 4 == 0) == late
        rollups.apply_increment(path, name, d.where(some), calls.where(some), unit)
    key = rollups.UNITS[unit]
    out = rollups.rollup(spark, path, unit)
    return out.withColumns({"avg_score_k": times(F.col("avg_suspicion_score"), 1000), "avg_us": times(F.col("avg_processing_time_ms"), 1000), key: F.col(key).cast("string")}).drop("avg_suspicion_score", "avg_processing_time_ms")


@query(_rollup_sql("CAST(created_at AS DATE)", "stat_date"))
def rollup_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_up(spark, sf_dir, "day")


@query(_rollup_sql("date_trunc('hour', created_at)::TIMESTAMP", "stat_time"))
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_up(spark, sf_dir, "hour")


_LE = " UNION ALL ".join(f"SELECT '{metrics.DURATION}_bucket' AS metric, 'le={b}' AS labels, count(*) FILTER (processing_time_ms / 1000.0 <= {b}) AS n FROM d" for b in metrics.BOUNDS)


@query(f"""WITH d AS (SELECT * FROM {DETECTIONS_SQL}), m AS (SELECT '{metrics.COUNT}' AS metric, 'is_fake=' || is_fake || ',risk_level=' || risk_level AS labels, count(*) AS n FROM d WHERE risk_level IS NOT NULL GROUP BY ALL
UNION ALL {_LE} UNION ALL SELECT '{metrics.DURATION}_bucket', 'le=+Inf', count(*) FROM d UNION ALL SELECT '{metrics.DURATION}_count', '', count(*) FROM d)
SELECT metric, labels, n * 1000 AS value_k FROM m UNION ALL SELECT '{metrics.DURATION}_sum', '', CAST(sum(processing_time_ms) AS BIGINT) FROM d""")
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.detection_metrics(t.detections(spark, sf_dir))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("metric", said.alias("labels"), times(F.col("value"), 1000).alias("value_k"))
