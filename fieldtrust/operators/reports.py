"""Reports over the detection table: each is one aggregation with partial sums before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = {"risk": "risk_level", "content": "content_type", "source": "geo_source", "device": "device_id"}


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(b > 0, F.floor(a / b * 10**digits + 0.5) / 10**digits).otherwise(0.0)


def batch_counts(df: DataFrame) -> DataFrame:
    """Counters of a scored batch."""
    risk = lambda k: F.count_if(F.col("risk_level") == k)
    hit = lambda c: F.count_if(F.col(c) > 0)
    n, high, medium = F.count("*"), risk("high"), risk("medium")
    return df.agg(
        n.alias("total"), F.count_if("is_fake").alias("fake"), F.count_if(~F.col("is_fake")).alias("normal"), F.count_if(~F.col("is_fake") & (F.col("risk_level") == "medium")).alias("suspicious"),
        high.alias("high"), medium.alias("medium"), (n - high - medium).alias("low"), F.avg("suspicion_score").alias("avg_score"),
        hit("geo_score").alias("geo_hits"), hit("text_score").alias("text_hits"), hit("simhash_score").alias("simhash_hits"), hit("semantic_score").alias("semantic_hits"),
    )


def daily_summary(df: DataFrame, as_of: str) -> DataFrame:
    """Today's and yesterday's counts, their difference, totals, pending reviews and the share of fakes, as of a day."""
    day, today = F.to_date("created_at"), F.to_date(F.lit(as_of))
    at = lambda k: F.count_if(day == F.date_sub(today, k))
    s = df.agg(at(0).alias("today"), at(1).alias("yesterday"), F.count("*").alias("total"), F.count_if("is_fake").alias("fake"), F.count_if(F.col("review_status") == "pending").alias("pending"))
    return s.withColumns({"delta": F.col("today") - F.col("yesterday"), "fake_rate": ratio(F.col("fake"), F.col("total"))})


def period(as_of: str, name: str = "today", start: str | None = None, end: str | None = None) -> tuple[Column, Column]:
    """[from, to) of a named period or a custom one, whose last day counts."""
    today = F.to_date(F.lit(as_of))
    tomorrow = F.date_add(today, 1)
    if name == "custom":
        return F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(end)), 1)
    return {"today": (today, tomorrow), "yesterday": (F.date_sub(today, 1), today), "week": (F.date_sub(today, 7), tomorrow), "month": (F.date_sub(today, 30), tomorrow)}[name]


def overview(df: DataFrame, as_of: str, name: str = "week", start: str | None = None, end: str | None = None) -> DataFrame:
    a, b = period(as_of, name, start, end)
    rows = df.where((F.col("created_at") >= a) & (F.col("created_at") < b))
    s = rows.agg(F.count("*").alias("total"), F.count_if("is_fake").alias("fake"), F.count_if(F.col("risk_level") == "high").alias("high"), F.avg("suspicion_score").alias("avg_score"), F.count_distinct("device_id").alias("devices"))
    return s.withColumn("fake_rate", ratio(F.col("fake"), F.col("total")))


def trend(df: DataFrame, granularity: str = "day") -> DataFrame:
    """By hour, day, week or month: rows, fakes and their share."""
    if granularity not in ("hour", "day", "week", "month"):
        raise ValueError(f"unknown granularity {granularity!r}")
    g = df.groupBy(F.date_trunc(granularity, "created_at").alias("bucket")).agg(F.count("*").alias("total"), F.count_if("is_fake").alias("fake"))
    return g.withColumn("fake_rate", ratio(F.col("fake"), F.col("total"))).orderBy("bucket")


def distribution(df: DataFrame, dimension: str, limit: int | None = None) -> DataFrame:
    """Counts by a dimension (nulls as "unknown"; devices: the ten most), with shares of the total shown."""
    limit = 10 if dimension == "device" and limit is None else limit
    g = df.groupBy(F.coalesce(F.col(DIMENSIONS.get(dimension, dimension)).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value")
    shown = g.limit(limit) if limit else g
    total = shown.agg(F.sum("n").alias("all"))
    return shown.join(F.broadcast(total)).select("value", "n", ratio(F.col("n"), F.col("all")).alias("share"))  # one row


def risk_levels(df: DataFrame) -> DataFrame:
    return df.groupBy("risk_level").agg(F.count("*").alias("n"))


def most_fakes(df: DataFrame, by: str, n: int = 10, order: str = "id") -> DataFrame:
    """The ten devices or users with the most fakes; ties by first row seen."""
    g = df.where("is_fake").groupBy(by).agg(F.count("*").alias("fakes"), F.min(order).alias("first"))
    return g.orderBy(F.col("fakes").desc(), "first").limit(n).drop("first")


def anomaly_counts(df: DataFrame) -> DataFrame:
    kinds = ("geo", "text", "simhash", "semantic")
    s = df.agg(*[F.count_if(F.col(f"{k}_score") > 0).alias(k) for k in kinds])
    return s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("x.*")


def tenant_days(df: DataFrame) -> DataFrame:
    """Sums and means by tenant and day."""
    return df.groupBy("tenant_id", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("total"), F.count_if("is_fake").alias("fake"), F.count_if(F.col("risk_level") == "high").alias("high"), F.count_if(F.col("risk_level") == "medium").alias("medium"),
        F.count_if(F.col("risk_level") == "low").alias("low"), F.avg("suspicion_score").alias("avg_score"), F.avg("processing_time_ms").alias("avg_ms"),
    )


def sample_statistics(df: DataFrame, labels: tuple[str, ...] = ("real", "suspicious", "fake", "unknown")) -> DataFrame:
    """Samples by label, with zeros for labels that none has, and how many are verified."""
    every = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    g = df.groupBy("label").agg(F.count("*").alias("n"), F.count_if("verified").alias("verified"))
    return every.join(g, "label", "full").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("verified", F.lit(0)).alias("verified"))


def log_statistics(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("total"), F.avg("confidence").alias("avg_confidence"), F.avg("processing_time_ms").alias("avg_ms"), ratio(F.count_if(F.col("result") == "fake"), n).alias("fake_ratio"), ratio(F.count_if(F.col("result") == "suspicious"), n).alias("suspicious_ratio"))


def confusion(df: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall, F1 and the four counts of 0/1 columns; a division by zero is 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    s = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return s.withColumns({"accuracy": div(tp + tn, tp + fp + fn + tn), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn)})


def recent_counts(df: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Rows of the last hours, and by hour."""
    end = F.to_timestamp(F.lit(as_of))
    rows = df.where((F.col("created_at") > end - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col("created_at") <= end))
    return rows.agg(F.count("*").alias("total")).withColumn("per_hour", F.col("total") / hours)


def rule_trial(scored: DataFrame, hit: Column, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(hits, rows, rate) of a rule on scored rows, and its first examples."""
    counts = scored.agg(F.count_if(hit).alias("hit_count"), F.count("*").alias("total_count")).withColumn("hit_rate", ratio(F.col("hit_count"), F.col("total_count")))
    return counts, scored.where(hit).orderBy("seq").limit(n)


def histogram(df: DataFrame, column: str, low: float = 0.0, high: float = 100.0, bins: int = 20) -> DataFrame:
    """Equal bins; the upper end counts in the last."""
    b = F.least(F.greatest(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, column: str, by: str) -> DataFrame:
    q = F.percentile(column, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return df.groupBy(by).agg(q.alias("q")).select(by, *[F.col("q")[i].alias(k) for i, k in enumerate(("low", "q1", "median", "q3", "high"))])


def by_category(df: DataFrame, category: str, key: str, value: str) -> DataFrame:
    """Settings by category, in the order of their keys; categories are few and small."""
    return df.groupBy(category).agg(F.array_sort(F.collect_list(F.struct(key, value))).alias("items"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def daily_rollup(df: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """The rollup table: a row for each tenant and day with its eighteen measures; ``calls(tenant_id, created_at, status)`` gives the last but the reviews'."""
    day = F.to_date("created_at").alias("stat_date")
    risk = lambda k: F.count_if(F.col("risk_level") == k)
    hit = lambda k: F.count_if(F.col(f"{k}_score") > 0)
    review = lambda *k: F.count_if(F.col("review_status").isin(*k))
    g = df.groupBy("tenant_id", day).agg(
        F.count("*").alias("total_records"), F.count_if("is_fake").alias("fake_records"), F.count_if(~F.col("is_fake")).alias("normal_records"), review("pending").alias("pending_records"),
        risk("high").alias("high_risk_count"), risk("medium").alias("medium_risk_count"), risk("low").alias("low_risk_count"), F.avg("suspicion_score").alias("avg_suspicion_score"),
        F.avg("processing_time_ms").alias("avg_processing_time_ms"), hit("geo").alias("geo_anomaly_count"), hit("text").alias("text_anomaly_count"), hit("simhash").alias("duplicate_count"),
        hit("semantic").alias("cluster_anomaly_count"), review("approved", "rejected").alias("review_count"), review("approved").alias("review_approved"), review("rejected").alias("review_rejected"),
    )
    if calls is None:
        return g.withColumns({"api_calls": F.lit(0).cast("long"), "api_errors": F.lit(0).cast("long")})
    c = calls.groupBy("tenant_id", day).agg(F.count("*").alias("api_calls"), F.count_if(F.col("status") >= 400).alias("api_errors"))
    out = g.join(c, ["tenant_id", "stat_date"], "full")
    measures = [x for x in out.columns if x not in ("tenant_id", "stat_date", "avg_suspicion_score", "avg_processing_time_ms")]
    return out.withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in measures})


def feature_overview(features: DataFrame) -> DataFrame:
    """Features by type and in all (type null)."""
    return features.rollup("feature_type").agg(F.count("*").alias("n"))


def metrics_line(name: Column | str, metrics: DataFrame) -> DataFrame:
    """``line``: a model's metrics as one row of a comparison; without samples it says so."""
    n = name if isinstance(name, Column) else F.lit(name)
    said = F.format_string("%-24s 样本=%-6d Acc=%.4f  P=%.4f  R=%.4f  F1=%.4f", n, "sample_count", "accuracy", "precision", "recall", "f1")
    return metrics.withColumn("line", F.when(F.coalesce("sample_count", F.lit(0)) > 0, said).otherwise(F.format_string("%-24s 样本不足，无法评估", n)))
