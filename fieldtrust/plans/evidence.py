"""Registered queries that return what others only use: reasons and advice, spreads of places, the network's own score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.operators import crossval, decision, ml, output, spatial
from fieldtrust.operators.graph import checkpoint_dir
from fieldtrust.plans import tables as t
from fieldtrust.plans.registry import _FUSE_SQL, _OUT_SQL, _verdicts, query, times, ts


@query(f"""WITH {_FUSE_SQL}, l AS (SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN 'place' END, CASE WHEN event_id % 3 = 0 THEN 'text' END, CASE WHEN cv > 0 AND event_id % 4 = 0 THEN 'place' END, CASE WHEN cv > 0 THEN 'platforms' END,
CASE WHEN ai > 0 THEN 'text' END, CASE WHEN ai > 0 AND event_id % 7 = 0 THEN '' END, CASE WHEN event_id % 5 = 0 THEN 'input' END], lambda x: x <> '') AS said, CASE WHEN hard OR score >= 60 THEN 'high' WHEN score >= 35 OR vote >= 0.5 THEN 'medium' ELSE 'low' END AS risk FROM f)
SELECT event_id, array_to_string(list_filter(said, lambda x, i: list_position(said, x) = i), '|') AS reasons, CASE risk WHEN 'high' THEN '{decision.RECOMMENDATIONS["high"]}' WHEN 'medium' THEN '{decision.RECOMMENDATIONS["medium"]}' ELSE '{decision.RECOMMENDATIONS["low"]}' END AS recommendation FROM l""")
def fused_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons of all sources, each once in the order said, and the advice."""
    e = F.col("event_id")
    said = lambda *of: F.array_compact(F.array(*[F.when(c, x) for c, x in of]))
    df = t.read(spark, sf_dir, "events").select(
        "event_id",
        F.struct(((e * 37) % 101 + 0.123).cast("double").alias("suspicion_score"), (e % 4 == 0).alias("is_fake"), (F.lit(0.5) + (e % 50) / 100.0).alias("confidence"), (e % 29 == 0).alias("high_severity_hit"), said((e % 2 == 0, "place"), (e % 3 == 0, "text")).alias("reasons")).alias("rules"),
        F.when(e % 3 > 0, F.struct(F.when(e % 3 == 1, "high").otherwise("low").alias("risk_level"), ((e % 10) / 10.0).alias("confidence"), said((e % 4 == 0, "place"), (F.lit(True), "platforms")).alias("risk_reasons"))).alias("cross_validation"),
        F.when(e % 5 > 0, F.struct(F.when(e % 5 == 1, "fake").when(e % 5 == 2, "suspicious").otherwise("real").alias("label"), ((e % 7) / 7.0).alias("confidence"), said((F.lit(True), "text"), (e % 7 == 0, "")).alias("risk_factors"))).alias("ai"),
        said((e % 5 == 0, "input")).alias("warnings"),
    )
    return decision.fuse(df).select("event_id", F.array_join("fused_reasons", "|").alias("reasons"), "recommendation")


_SPOTS_SQL = "m AS (SELECT event_id AS record_id, k AS platform, (event_id + k) % 3 = 0 OR event_id % 6 = 1 AS found, 30 + (event_id * (k + 1)) % 100 / 10000.0 AS lat, 110 + (event_id * (k + 2)) % 97 / 10000.0 AS lon FROM events, range(3) r(k))"
_APART = "max(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) * 1000)"


@query(f"""WITH {_SPOTS_SQL}, s AS (SELECT record_id, {_APART} AS metres FROM m a JOIN m b USING (record_id) WHERE a.found AND b.found AND a.platform < b.platform GROUP BY 1), n AS (SELECT record_id, count(*) FILTER (found) AS n FROM m GROUP BY 1)
SELECT record_id, n AS n_found, coalesce({ts('metres * 10')}, -1) AS spread_dm, CASE WHEN n = 0 THEN 1 WHEN n = 1 THEN 1 WHEN metres > 500 THEN 1 ELSE 0 END AS n_reasons FROM n LEFT JOIN s USING (record_id)""")
def platform_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart platforms place a record, and what the cross-check says of it."""
    e, k = F.col("event_id"), F.col("platform")
    m = t.read(spark, sf_dir, "events").select("event_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("platform"))
    m = m.select(e.alias("record_id"), "platform", (((e + k) % 3 == 0) | (e % 6 == 1)).alias("found"), F.lit(0.5).alias("similarity"), (F.lit(30) + (e * (k + 1)) % 100 / 10000.0).alias("latitude"), (F.lit(110) + (e * (k + 2)) % 97 / 10000.0).alias("longitude"))
    spread = spatial.platform_spread(m).select("record_id", times(F.col("max_metres"), 10).alias("spread_dm"))
    return crossval.validate(m).select("record_id", "n_found", F.size("risk_reasons").alias("n_reasons")).join(spread, "record_id", "left").fillna(-1, ["spread_dm"])


@query(f"""WITH {_OUT_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (risk_level = 'fake') AS f, count(*) FILTER (risk_level = 'suspicious') AS q FROM c)
SELECT array_to_string(list_filter([CASE WHEN f > 0.2 * n THEN '虚假数据比例较高(' || printf('%.1f', f * 100.0 / n) || '%)，建议加强数据审核' END, CASE WHEN q > 0.3 * n THEN '可疑数据比例较高(' || printf('%.1f', q * 100.0 / n) || '%)，建议进行人工复核' END,
CASE WHEN f > 0 THEN '发现' || f || '条虚假数据，建议及时清理' END, CASE WHEN q > 0 THEN '发现' || q || '条可疑数据，建议进一步核实' END], lambda x: x IS NOT NULL), '|') AS advice FROM s""")
def verdict_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.summary(_verdicts(spark, sf_dir)).select(F.array_join("recommendations", "|").alias("advice"))


@query()
def neural_subscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network's score of every document, from its text and the place given to it. Learned from the labelled ones; ``tests/test_network.py`` has the forward pass."""
    from fieldtrust.operators import geo_rules
    from fieldtrust.plans.scenarios import _placed

    d = geo_rules.analyze(_placed(spark, sf_dir)).select("seq", "text", "device_id", "timestamp", "latitude", "longitude", "geo_score", "geo_anomalies")
    checkpoint_dir(spark)
    v = ml.neural_features(d).select("seq", "neural_vector").checkpoint()  # learned from and scored
    truth = t.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), (F.col("quality") == 0).cast("int").alias("label"))
    model = ml.train_network(v.join(truth, "seq").orderBy("seq"), iterations=30)
    return ml.neural_scores(v, model).select(F.col("seq").alias("doc_id"), times(F.col("neural_score"), 100).alias("neural_c"))
