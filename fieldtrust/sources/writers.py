"""Writers of results, exports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.hashing import content_hash

EXPORT_ROWS = 10_000


def to_detections(df: DataFrame, tenant_id: int, as_of: str) -> DataFrame:
    """Scored rows as rows of the detection table: hashed content, review pending."""
    return df.withColumns({
        "tenant_id": F.lit(tenant_id).cast("long"), "content_hash": content_hash(F.col("text")), "review_status": F.lit("pending"), "created_at": F.to_timestamp(F.lit(as_of)),
    })


def append_detections(df: DataFrame, path: str) -> None:
    """Appended by tenant and day."""
    df.withColumn("day", F.to_date("created_at")).write.partitionBy("tenant_id", "day").mode("append").parquet(path)


def export_records(df: DataFrame, path: str, rows: int = EXPORT_ROWS) -> None:
    """The newest rows, as many as an export holds (a limit that is the feature), with texts of reasons."""
    flat = df.withColumn("reasons", F.array_join("reasons", "; ")) if "reasons" in df.columns else df
    flat.orderBy(F.col("created_at").desc(), "id").limit(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Quotes within a value are doubled, as ``readers.read_csv`` and spreadsheets take them."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_report_csv(df: DataFrame, path: str) -> None:
    """With the first three violations in one column."""
    export_csv(df.withColumn("violations", F.array_join(F.slice("violations", 1, 3), "; ")), path)


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        nested = [c for c, k in df.dtypes if k.startswith(("array", "struct", "map"))]
        export_csv(df.withColumns({c: F.to_json(c) for c in nested}), path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unsupported format {kind!r}")


def export_training(samples: DataFrame, path: str) -> None:
    """Verified samples."""
    export(samples.where("verified"), path)


def flush_log(df: DataFrame, path: str, threshold: int) -> bool:
    """Append a log to its table once it has more rows than the threshold; whether it did."""
    if df.limit(threshold + 1).count() <= threshold:
        return False
    df.write.mode("append").parquet(path)
    return True


def publish(df: DataFrame, servers: str, checkpoint: str, topic: str = "detection-results", key: str = "request_id"):
    """A stream of results to a topic, acknowledged by all replicas."""
    out = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
    return out.writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3", "checkpointLocation": checkpoint}).start()
