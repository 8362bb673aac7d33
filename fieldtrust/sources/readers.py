"""Readers of files, tables and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust import schemas

# fixed values: headings by which an uploaded column is known
HEADINGS = {
    "名称": "name", "地址": "address", "纬度": "latitude", "经度": "longitude", "电话": "phone", "营业时间": "business_hours", "类别": "category", "描述": "description",
    "文本": "text", "设备ID": "device_id", "用户ID": "user_id", "时间戳": "timestamp", "lat": "latitude", "lng": "longitude", "lon": "longitude", "content": "text",
}
REQUIRED = ("name", "latitude", "longitude")


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "GBK")) -> DataFrame:
    """CSV with a header, as UTF-8 where all lines are valid, else in the second encoding."""
    valid = not spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    e = encodings[0] if valid else encodings[1]
    if not valid:  # Spark 4 reads other charsets than the Unicode ones only on request
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", e).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, one object, or either under ``data``."""
    df = spark.read.option("multiLine", True).json(path)
    if "data" not in df.columns:
        return df
    kind = df.schema["data"].dataType.typeName()
    return df.select(F.explode("data").alias("data")).select("data.*") if kind == "array" else df.select("data.*")


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of each workbook, all columns as text; needs openpyxl on the executors."""
    import pandas as pd

    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading Excel needs openpyxl") from e
    import io

    files = spark.read.format("binaryFile").load(path).select("content")
    head = list(pd.read_excel(io.BytesIO(bytes(files.first()["content"])), nrows=0).columns)

    def rows(frames):
        for f in frames:
            for content in f["content"]:
                sheet = pd.read_excel(io.BytesIO(content), dtype=str)
                yield sheet.reindex(columns=head).where(sheet.notna(), None)

    return files.mapInPandas(rows, ", ".join(f"`{c}` string" for c in head))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix in ("xlsx", "xls"):
        return read_excel(spark, path)
    if suffix == "json":
        return read_json(spark, path)
    raise ValueError(f"unsupported file type .{suffix}")


def with_known_headings(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Headings in either language to column names; a missing required column is an error."""
    names = {c: HEADINGS.get(c.strip(), HEADINGS.get(c.strip().lower(), c.strip())) for c in df.columns}
    out = df.withColumnsRenamed(names)
    if missing := [c for c in required if c not in out.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out


def read_tenant(spark: SparkSession, path: str, tenant_id: int) -> DataFrame:
    """Detections of one tenant; the condition prunes partitions or reaches the scan."""
    return spark.read.parquet(path).where(F.col("tenant_id") == tenant_id)


def read_table(spark: SparkSession, url: str, table: str, tenant_id: int, **options: str) -> DataFrame:
    """The same over JDBC; the condition is sent to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where(F.col("tenant_id") == tenant_id)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature library: an object with a list ``features``, or the list."""
    df = spark.read.option("multiLine", True).json(path)
    df = df.select(F.explode("features").alias("f")).select("f.*") if "features" in df.columns else df
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.FEATURE])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("samples").alias("s")).select("s.*") if "samples" in df.columns else df


def read_training(spark: SparkSession, path: str) -> DataFrame:
    kind = schemas.struct(record_id=schemas.S, device_id=schemas.S, user_id=schemas.S, timestamp=schemas.L, content=schemas.struct(text=schemas.S), geo=schemas.struct(latitude=schemas.D, longitude=schemas.D), label=schemas.S)
    return spark.read.schema(kind).option("multiLine", True).json(path)


def log_tail(spark: SparkSession, path: str, lines: int = 100, level: str | None = None) -> DataFrame:
    """The last lines of a log file, then those of a level: the limit comes first."""
    df = spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("line"), "value")
    tail = df.orderBy(F.col("line").desc()).limit(lines)
    return (tail if level is None else tail.where(F.contains(F.col("value"), F.lit(level)))).orderBy("line")


def requests(spark: SparkSession, servers: str, topic: str = "detection-requests", **options: str) -> DataFrame:
    """Requests of a topic from its beginning, as text."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", **options}).load().selectExpr("CAST(value AS STRING) AS value")


def platform_table(matches: DataFrame, platforms: tuple[str, ...] = ("osm", "amap", "baidu")) -> DataFrame:
    """A row for each record and platform; what a platform doesn't have is not found."""
    ids = matches.select("record_id").distinct()
    every = ids.select("record_id", F.explode(F.array(*map(F.lit, platforms))).alias("platform"))
    return every.join(matches, ["record_id", "platform"], "left").withColumns({"found": F.coalesce("found", F.lit(False)), "similarity": F.coalesce("similarity", F.lit(0.0))})


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """System settings of a JSON file ``{"configs": [...]}``; absent fields take their defaults."""
    item = "config_key string, config_value string, description string, category string, is_editable boolean, updated_at string, updated_by string"
    rows = spark.read.schema(f"configs array<struct<{item.replace(' string', ':string').replace(' boolean', ':boolean')}>>").option("multiLine", True).json(path).select(F.explode("configs").alias("c")).select("c.*")
    return rows.na.fill({"description": "", "category": "general", "is_editable": True, "updated_at": "", "updated_by": ""})
