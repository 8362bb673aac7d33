"""Verdicts for people: output scores, alerts, summaries, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: labels' risk levels, colours and advice
LABEL_RISK = {"fake": "fake", "suspicious": "suspicious", "real": "real"}
COLOURS = {"high": "red", "medium": "orange", "low": "green"}
INTENSITY = {"high": 1.0, "medium": 0.6, "low": 0.2}


def lookup(c: Column, table: dict, default) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in table.items()], F.lit(default))


def label_risk(label: Column) -> Column:
    return lookup(label, LABEL_RISK, "suspicious")


def output_score(confidence: Column, risk: Column, platforms: Column, violations: Column) -> Column:
    """0 to 100: confidence by label's band, a bonus for three platforms and a malus for none, five off for each violation. Null platforms or violations were not looked at."""
    s = F.floor(confidence * 100)
    s = F.when(risk == "fake", F.least(s, F.lit(49))).when(risk == "suspicious", F.least(F.greatest(s, F.lit(50)), F.lit(79))).otherwise(F.greatest(s, F.lit(80)))
    s = F.when(platforms >= 3, F.least(s + 5, F.lit(100))).when(platforms == 0, F.greatest(s - 10, F.lit(0))).otherwise(s)
    return F.when(violations.isNotNull(), F.greatest(s - violations * 5, F.lit(0))).otherwise(s).cast("int")


def alerts(df: DataFrame) -> DataFrame:
    """Rows to be told of: fakes as critical, suspicious rows under 0.4 confidence as warnings."""
    level = F.when(F.col("risk_level") == "fake", "critical").when((F.col("risk_level") == "suspicious") & (F.col("confidence") < 0.4), "warning")
    return df.withColumn("alert_level", level).where("alert_level IS NOT NULL").withColumn("status", F.lit("pending"))


def summary(df: DataFrame) -> DataFrame:
    """One row: counts and ratios by label, mean confidence and score, and what is advised. No rows give none."""
    c = lambda k: F.count_if(F.col("risk_level") == k)
    n = F.count("*")
    s = df.agg(n.alias("total"), c("real").alias("real"), c("suspicious").alias("suspicious"), c("fake").alias("fake"), F.avg("confidence").alias("avg_confidence"), F.avg("score").alias("avg_score")).where("total > 0")
    share = lambda k: F.col(k) / F.col("total")
    advice = F.array_compact(
        F.array(
            F.when(share("fake") > 0.2, F.format_string("虚假数据比例较高(%.1f%%)，建议加强数据审核", share("fake") * 100)),
            F.when(share("suspicious") > 0.3, F.format_string("可疑数据比例较高(%.1f%%)，建议进行人工复核", share("suspicious") * 100)),
            F.when(F.col("fake") > 0, F.format_string("发现%d条虚假数据，建议及时清理", F.col("fake"))),
            F.when(F.col("suspicious") > 0, F.format_string("发现%d条可疑数据，建议进一步核实", F.col("suspicious"))),
        )
    )
    advice = F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("数据质量良好，建议继续保持审核标准")))
    return s.withColumns({"real_ratio": share("real"), "suspicious_ratio": share("suspicious"), "fake_ratio": share("fake"), "high_risk": F.col("fake") + F.col("suspicious"), "recommendations": advice})


def top_violations(df: DataFrame, n: int = 10, column: str = "violations", order: str = "seq") -> DataFrame:
    """The most frequent violations; ties by first row seen."""
    v = df.select(order, F.explode(column).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return v.orderBy(F.col("n").desc(), "first", "violation").limit(n).drop("first")


def map_points(df: DataFrame) -> DataFrame:
    """Marker and heat projections."""
    return df.select("record_id", "latitude", "longitude", lookup(F.col("risk_level"), COLOURS, "gray").alias("color"), lookup(F.col("risk_level"), INTENSITY, 0.2).alias("intensity"))


def display_confidence(score: Column, risk: Column) -> Column:
    """The confidence of a result table, from score and risk."""
    return F.when(risk == "low", F.least(F.lit(95.0), (100 - score) / 2 + 50)).when(risk == "medium", F.abs(50 - score) / 4 + 50).otherwise(F.least(F.lit(95.0), score / 2 + 50))


def card_confidence(score: Column, risk: Column) -> Column:
    """The confidence of a result card: the score's distance from what the risk would have it, kept within 50 and 99."""
    return F.greatest(F.lit(50.0), F.least(F.lit(99.0), 100 - F.abs(score - F.when(risk == "low", 100.0).otherwise(0.0))))


def with_places(results: DataFrame, records: DataFrame, order: str = "seq") -> DataFrame:
    """Results with the place of the record at the same position; null where there is none."""
    return results.join(records.select(order, "latitude", "longitude"), order, "left")
