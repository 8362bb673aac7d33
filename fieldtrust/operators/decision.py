"""Fused score, decision, risk level and confidence, and the fusion of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.scoring import max_or, round_half_even
from fieldtrust.params import DEFAULT, Params

# fixed values: scores by which other sources vote, and the advice by risk
CV_SCORES = {"high": 85.0, "medium": 55.0, "low": 15.0}
AI_SCORES = {"fake": 90.0, "suspicious": 55.0, "real": 10.0}
OTHER_SCORE = 30.0
RECOMMENDATIONS = {"high": "建议立即拦截，高风险虚假内容", "medium": "建议人工复核，可疑内容", "low": "正常内容，可放行"}


def total(geo: Column, text: Column, simhash: Column, semantic: Column, has_text: Column, has_geo: Column, neural: Column | None = None, batch: bool = False, p: Params = DEFAULT) -> Column:
    """The weighted mean of the sub-scores; absent text, place or model score has no weight."""
    parts = [(geo, F.when(has_geo, p.geo_weight).otherwise(0.0)), (text, F.when(has_text, p.text_weight).otherwise(0.0)), (simhash, F.lit(p.simhash_weight)), (semantic, F.lit(p.batch_semantic_weight if batch else p.semantic_weight))]
    if neural is not None:
        parts.append((F.coalesce(neural, F.lit(0.0)), F.when(neural.isNotNull(), p.neural_weight).otherwise(0.0)))
    weight = sum((w for _, w in parts[1:]), parts[0][1])
    score = sum((s * w for s, w in parts[1:]), parts[0][0] * parts[0][1])
    return F.when(weight > 0, score / weight).otherwise(0.0)


def decide(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds ``is_fake`` and ``forced_high`` from ``total_score``, the anomalies, ``marketing_count``, ``simhash_score`` and ``semantic_score``; the first clause that holds decides."""
    severity = lambda c: max_or(F.transform(c, lambda a: a["severity"]))
    backed = (F.size("geo_anomalies") > 0) | (F.col("simhash_score") > 0) | (F.col("semantic_score") > 0)
    forced = (severity("geo_anomalies") >= p.high_severity) | (backed & (severity("text_anomalies") >= p.high_severity))
    fake = forced | (F.col("total_score") >= p.high) | (backed & ((F.col("total_score") >= p.medium) | (F.col("marketing_count") >= p.marketing_fake)))
    return df.withColumns({"forced_high": forced, "is_fake": fake})


def risk_of_score(score: Column, p: Params = DEFAULT) -> Column:
    return F.when(score >= p.high, "high").when(score >= p.medium, "medium").otherwise("low")


def risk_and_confidence(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds ``risk_level`` and ``confidence`` (rounded to 2)."""
    s = F.col("total_score")
    at_least_medium = F.col("is_fake") | (F.col("marketing_count") >= p.marketing_medium) | (F.size("geo_anomalies") > 0)
    risk = F.when(F.col("forced_high"), "high").when(s >= p.medium, risk_of_score(s, p)).when(at_least_medium, "medium").otherwise("low")
    away = F.when(risk == "high", s - p.high).when(risk == "medium", F.least(F.abs(s - p.medium), F.abs(s - p.high))).otherwise(p.medium - s)
    sure = F.greatest(F.least(away * p.confidence_step + 0.5, F.lit(0.99)), F.lit(0.5))
    return df.withColumns({"risk_level": risk, "confidence": round_half_even(F.when(F.col("forced_high"), F.greatest(sure, F.lit(0.85))).otherwise(sure), 2)})


def reasons(batch: bool = False) -> Column:
    """The reasons in the order place, text, copies, cluster, model."""
    said = lambda c, mark: F.transform(c, lambda a: F.concat(F.lit(f"[{mark}] "), a["description"]))
    same = F.format_string("[重复] 相似度%.1f%%", F.col("simhash_score")) if batch else F.format_string("[重复] 与%d条记录相似度%.1f%%", F.col("similar_records"), F.col("simhash_score"))
    many = F.format_string("[聚类] 批量相似内容(%d条)" if batch else "[聚类] 检测到批量相似内容(%d条)", F.col("cluster_size"))
    neural = F.when(F.col("neural_score") >= 50, F.format_string("[AI] 模型预测倾向虚假 (虚假概率: %.1f%%)", F.col("neural_score")))
    tail = F.array_compact(F.array(F.when(F.col("simhash_score") > 0, same), F.when(F.col("semantic_score") > 0, many), neural))
    return F.concat(said("geo_anomalies", "GEO"), said("text_anomalies", "文本"), tail)


def has_text(text: Column, p: Params = DEFAULT) -> Column:
    """Whether a text is long enough to weigh."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= p.min_length


def score(df: DataFrame, p: Params = DEFAULT, batch: bool = False) -> DataFrame:
    """All of it, for rows with the anomalies and sub-scores; ``neural_score`` may be null. Missing duplicate or cluster columns count as none. ``has_text`` may stand for ``text``."""
    kinds = {"simhash_score": "double", "semantic_score": "double", "similar_records": "int", "cluster_size": "long", "neural_score": "double"}
    for c, kind in kinds.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None if c == "neural_score" else 0).cast(kind))
    said = F.col("has_text") if "has_text" in df.columns else has_text(F.col("text"), p)
    has_geo = ~((F.coalesce("latitude", F.lit(0.0)) == 0) & (F.coalesce("longitude", F.lit(0.0)) == 0))
    df = df.withColumn("total_score", total(F.col("geo_score"), F.col("text_score"), F.col("simhash_score"), F.col("semantic_score"), said, has_geo, F.col("neural_score"), batch, p))
    df = risk_and_confidence(decide(df, p), p)
    return df.withColumns({"suspicion_score": round_half_even(F.col("total_score"), 2), "reasons": reasons(batch)})


def fuse(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Fuse ``rules(suspicion_score, is_fake, confidence, high_severity_hit, reasons)``, a nullable ``cross_validation(risk_level, confidence, risk_reasons)``, a nullable ``ai(label, confidence, risk_factors)`` and ``warnings`` into
    ``fused_score, fused_risk, fused_fake, fused_confidence, fused_label, fused_reasons, recommendation, weights``."""
    r, cv, ai = F.col("rules"), F.col("cross_validation"), F.col("ai")
    pick = lambda c, table: F.coalesce(*[F.when(c == k, v) for k, v in table.items()], F.lit(OTHER_SCORE))

    def source(name: str, value: Column, sure: Column, fake: Column) -> Column:
        sure = F.coalesce(sure.cast("double"), F.lit(0.0))
        raw = F.greatest(sure, F.lit(0.1)) * p.reliability.get(name, 0.5)
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("score"), sure.alias("confidence"), F.coalesce(fake, F.lit(False)).alias("fake"), raw.alias("raw"))

    sources = F.array_compact(
        F.array(
            source("rules", r["suspicion_score"], r["confidence"], r["is_fake"]),
            F.when(cv.isNotNull(), source("cross_validation", pick(cv["risk_level"], CV_SCORES), cv["confidence"], cv["risk_level"].isin("high", "medium"))),
            F.when(ai.isNotNull(), source("ai_model", pick(ai["label"], AI_SCORES), ai["confidence"], ai["label"] == "fake")),
        )
    )
    df = df.withColumn("_s", sources)
    s, n = F.col("_s"), F.size("_s")
    add = lambda f: F.aggregate(s, F.lit(0.0), lambda a, x: a + f(x))
    df = df.withColumn("_w", add(lambda x: x["raw"]))
    w = F.col("_w")
    df = df.withColumns({
        "_score": add(lambda x: x["raw"] / w * x["score"]),
        "_fake": add(lambda x: F.when(x["fake"], x["raw"] / w).otherwise(0.0)),
        "_sure": F.greatest(F.lit(0.0), F.least(F.lit(1.0), add(lambda x: x["raw"] / w * x["confidence"]))),
    })
    hard = F.coalesce(r["high_severity_hit"], F.lit(False))
    fake = hard | (F.col("_fake") >= 0.5)
    risk = risk_of_score(F.col("_score"), p)
    risk = F.when(hard, "high").when(fake & (risk == "low"), "medium").otherwise(risk)
    agree = F.size(F.array_distinct(F.transform(s, lambda x: x["fake"]))) == 1
    sure = F.when(n == 1, F.col("_sure")).when(agree, F.least(F.col("_sure") * ((n - 1) * 0.1 + 1), F.lit(0.99))).otherwise(F.col("_sure") * 0.85)
    said = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (r["reasons"], cv["risk_reasons"], ai["risk_factors"], F.col("warnings"))])
    label = F.when(fake, "fake").when(F.col("_score") < 30, "real").otherwise("suspicious")
    return df.withColumns({
        "fused_score": round_half_even(F.col("_score"), 2), "fused_risk": risk, "fused_fake": fake, "fused_confidence": round_half_even(sure, 4), "fused_label": label,
        "fused_reasons": F.array_distinct(F.filter(said, lambda x: x.isNotNull() & (x != ""))),
        "recommendation": F.coalesce(*[F.when(risk == k, v) for k, v in RECOMMENDATIONS.items()]),
        "weights": F.transform(s, lambda x: F.struct(x["name"].alias("name"), round_half_even(x["raw"] / w, 4).alias("weight"), x["score"].alias("score"))),
    }).drop("_s", "_w", "_score", "_fake", "_sure")


def invalid_first(df: DataFrame, errors: str = "errors") -> DataFrame:
    """Scored rows with those whose input failed its checks replaced: 100, high, fake, 0.95 sure, and the errors as the reason. Sub-scores are 100 for the place and 0 else."""
    bad = F.size(F.coalesce(F.col(errors), F.array().cast("array<string>"))) > 0
    fixed = {
        "suspicion_score": F.lit(100.0), "total_score": F.lit(100.0), "risk_level": F.lit("high"), "is_fake": F.lit(True), "confidence": F.lit(0.95), "geo_score": F.lit(100.0),
        "text_score": F.lit(0.0), "simhash_score": F.lit(0.0), "semantic_score": F.lit(0.0), "reasons": F.array(F.concat(F.lit("数据格式无效: "), F.array_join(errors, ", "))),
    }
    return df.withColumns({c: F.when(bad, v).otherwise(F.col(c)) for c, v in fixed.items() if c in df.columns} | {"recommendation": F.when(bad, "数据格式错误，请检查输入").otherwise(F.coalesce(*[F.when(F.col("risk_level") == k, v) for k, v in RECOMMENDATIONS.items()]))})
