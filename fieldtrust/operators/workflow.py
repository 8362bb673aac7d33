"""State machines over tables: an append-only log of events, of which the last valid one is the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REVIEW = {"approve": "approved", "reject": "rejected", "escalate": "escalated"}
METRICS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}


def review_state(records: DataFrame, events: DataFrame) -> DataFrame:
    """``records(record_id, ...)`` with ``review_status``, ``reviewer`` and ``ground_truth`` after ``events(record_id, seq, action, reviewer, value)``; deleted records go."""
    status = F.coalesce(*[F.when(F.col("action") == k, v) for k, v in REVIEW.items()])
    last = lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
    state = events.groupBy("record_id").agg(
        last(status, status.isNotNull()).alias("review_status"), last(F.col("reviewer"), status.isNotNull()).alias("reviewer"),
        last(F.col("value"), F.col("action") == "label").alias("ground_truth"), F.max(F.col("action") == "delete").alias("deleted"),
    )
    out = records.drop("review_status", "reviewer", "ground_truth").join(state, "record_id", "left")
    return out.where(~F.coalesce("deleted", F.lit(False))).drop("deleted").withColumn("review_status", F.coalesce("review_status", F.lit("pending")))


def alert_state(events: DataFrame) -> DataFrame:
    """Alerts after acknowledgements (of pending ones only) and resolutions (of unresolved ones): ``events(alert_id, seq, action)``."""
    before = Window.partitionBy("alert_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    resolved = F.coalesce(F.max(F.col("action") == "resolve").over(before), F.lit(False))
    acked = F.coalesce(F.max(F.col("action") == "acknowledge").over(before), F.lit(False))
    ok = events.withColumn("ok", F.when(F.col("action") == "acknowledge", ~resolved & ~acked).when(F.col("action") == "resolve", ~resolved).otherwise(True))
    last = lambda a: F.max(F.when(F.col("ok") & (F.col("action") == a), True).otherwise(False))
    s = ok.groupBy("alert_id").agg(last("resolve").alias("r"), last("acknowledge").alias("a"), F.count_if(~F.col("ok")).alias("refused"))
    return s.select("alert_id", F.when(F.col("r"), "resolved").when(F.col("a"), "acknowledged").otherwise("pending").alias("status"), "refused")


def merged(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Existing rows with ``changes(key, ..., seq, op)`` applied; ``op`` is upsert or delete, and of a key's changes the one with the greatest ``seq`` holds. Changes without a key are left out."""
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("op", *[c for c in existing.columns if c != key]), F.col("seq")).alias("_c"))
    last = last.select(key, "_c.*")
    kept = existing.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("op <> 'delete'").select(*existing.columns))


def triggered(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules ``(rule_id, metric, operator, threshold)`` that a metric row ``(metric, value)`` meets."""
    both = metrics.join(rules, "metric")
    hit: Column = F.lit(False)
    for name, test in METRICS.items():
        hit = hit | ((F.col("operator") == name) & test(F.col("value"), F.col("threshold")))
    return both.where(hit)


def with_audit(df: DataFrame, as_of: str) -> DataFrame:
    return df.withColumn("updated_at", F.to_timestamp(F.lit(as_of)))
