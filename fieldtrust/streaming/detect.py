"""Detection over streams: messages to scored rows, with devices, copies and like texts as keyed state of event time.

State is let go by time; a store bounded by eviction would depend on the order of unrelated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust import schemas
from fieldtrust.functions import geo, scoring
from fieldtrust.operators import decision, geo_rules, text_rules
from fieldtrust.params import DEFAULT, Params
from fieldtrust.streaming.state import BLOCKS, with_copies, with_device_state

LATE = "10 minutes"


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, dead letters) of JSON lines in ``value``."""
    m = lines.select("value", F.from_json("value", schemas.MESSAGE).alias("m"))
    ok = F.coalesce(F.col("m.request_id").isNotNull() & F.col("m.data.content.text").isNotNull(), F.lit(False))
    d = "m.data"
    good = m.where(ok).select(
        F.col("m.request_id").alias("request_id"), F.coalesce(f"{d}.device_id", F.lit("")).alias("device_id"), F.coalesce(f"{d}.user_id", F.lit("")).alias("user_id"),
        F.coalesce(F.col(f"{d}.timestamp").cast("double"), F.lit(0.0)).alias("timestamp"), F.coalesce(f"{d}.geo.latitude", F.lit(0.0)).alias("latitude"),
        F.coalesce(f"{d}.geo.longitude", F.lit(0.0)).alias("longitude"), F.col(f"{d}.content.text").alias("text"),
    )
    return good, m.where(~ok).select("value")


def once(requests: DataFrame, late: str = LATE) -> DataFrame:
    """Each request once: one sent again within the watermark's reach is dropped. Adds ``ts``, the event time, with its watermark; rows later than it are dropped by Spark.

    A request without a time (0 or less) has the time at which it is read.
    """
    ts = F.when(F.col("timestamp") > 0, F.timestamp_millis((F.col("timestamp") * 1000).cast("long"))).otherwise(F.current_timestamp())
    return requests.withColumn("ts", ts).withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def scored(requests: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Requests with device state to results: the rules and decision of the batch path."""
    km = geo.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("latitude"), F.col("longitude"))
    df = requests.withColumns({"step_km": km, "step_seconds": F.abs(F.col("timestamp") - F.col("prev_ts"))})
    df = df.withColumn("step_kmh", F.when(F.col("prev_ts").isNotNull(), geo.speed_kmh(F.col("step_km"), F.col("step_seconds"))))
    lat, lon = F.col("latitude"), F.col("longitude")
    found = F.array_compact(F.array(geo_rules.invalid_coordinate(lat, lon), geo_rules.out_of_range(lat, lon, p), geo_rules.frequency(p), geo_rules.movement(p)))
    df = df.withColumn("geo_anomalies", found).withColumn("geo_score", scoring.union(F.transform("geo_anomalies", lambda a: a["severity"])))
    return decision.score(text_rules.analyze(df, p), p).select("request_id", "device_id", "suspicion_score", "is_fake", "risk_level", "confidence", "reasons")


def detect(lines: DataFrame, p: Params = DEFAULT, late: str = LATE, blocks: int = BLOCKS) -> DataFrame:
    """Messages to results: each request once, with its device's state and what came before it."""
    good, _ = parsed(lines)
    return scored(with_copies(with_device_state(once(good, late)), p, blocks=blocks), p)


def detect_with_dead_letters(lines: DataFrame, p: Params = DEFAULT, late: str = LATE, blocks: int = BLOCKS) -> DataFrame:
    """As ``detect``, with messages that cannot be read as rows that only have ``dead``: one query feeds both sinks (``write_both``)."""
    _, bad = parsed(lines)
    return detect(lines, p, late, blocks).withColumn("dead", F.lit(None).cast("string")).unionByName(bad.select(F.col("value").alias("dead")), allowMissingColumns=True)


def windowed(events: DataFrame, ts: str = "ts", width: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by device and (sliding) window; rows later than the watermark are dropped by Spark."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), "device_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "device_id", "n")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Sessions of a device: rows less than ``gap`` apart, given out once the watermark has passed their end; later rows are dropped by Spark."""
    w = F.session_window(ts, gap)
    s = events.withWatermark(ts, late).groupBy(w.alias("w"), "device_id").agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return s.select("device_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "first", "last")


def write_batches(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Micro-batches to a folder each, overwritten when a batch is done again: rows arrive once."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    out = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def write_both(df: DataFrame, path: str, dead_path: str, checkpoint: str, **trigger):
    """Results and dead letters of one query to two folders, a batch to a folder each; a batch done again overwrites both."""

    def put(batch: DataFrame, n: int) -> None:
        batch.persist()
        batch.where("dead IS NULL").drop("dead").write.mode("overwrite").parquet(f"{path}/batch={n}")
        batch.where("dead IS NOT NULL").select("dead").write.mode("overwrite").parquet(f"{dead_path}/batch={n}")
        batch.unpersist()

    out = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()
