"""Text rules: projections over one scan for keywords, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions import scoring
from fieldtrust.functions import text as tx
from fieldtrust.operators import keywords
from fieldtrust.operators.geo_rules import anomaly
from fieldtrust.params import DEFAULT, Params

MARKETING = ("high_severity_marketing", "moderate_marketing", "suspicious_keywords")


def length_rule(text: Column, p: Params = DEFAULT) -> Column:
    n = F.length(tx.text_of(text))
    short = anomaly("too_short", F.format_string("文本过短: %d字符", n), 0.6, length=n)
    long_ = anomaly("too_long", F.format_string("文本过长: %d字符", n), 0.3, length=n)
    return F.when(n < p.min_length, short).when(n > p.max_length, long_)


def stuffing_rule(text: Column) -> Column:
    return F.when(tx.is_stuffed(text), anomaly("keyword_stuffing", F.lit("检测到关键词堆砌"), 0.8))


def marketing_words(p: Params = DEFAULT) -> tuple[str, ...]:
    return tx.ordered_union(p.keywords, p.default_keywords)


def marketing_stats(text: Column, found: Column, p: Params = DEFAULT) -> Column:
    """Struct (density, count, keywords) of what ``keywords.matches`` found: share of characters in marketing words (overlapping words each count), how many words, and the first five."""
    words, n = marketing_words(p), F.length(tx.text_of(text))
    density = F.when(n > 0, keywords.covered(found, words) / n).otherwise(0.0)
    return F.struct(density.alias("density"), F.size(found).alias("count"), keywords.words_of(F.slice(found, 1, 5), words).alias("keywords"))


def marketing_rule(stats: Column) -> Column:
    d, n = stats["density"], stats["count"]
    said = F.array_join(F.slice(stats["keywords"], 1, 3), ", ")
    high = anomaly("high_severity_marketing", F.concat(F.format_string("高密度营销词(密度%.1f%%): ", d * 100), said), 0.8, density=d, count=n)
    some = anomaly("moderate_marketing", F.concat(F.format_string("中等密度营销词(密度%.1f%%): ", d * 100), said), 0.5, density=d, count=n)
    many = anomaly("suspicious_keywords", F.concat(F.format_string("包含%d个营销词: ", n), said), F.least(n / 5, F.lit(0.4)), density=d, count=n)
    return F.when((d > 0.05) & (n >= 2), high).when(d > 0.02, some).when(n >= 3, many)


def template_matches(text: Column, p: Params = DEFAULT) -> Column:
    """The first two matches of each template, five at most."""
    t = tx.text_of(text)
    return F.slice(F.flatten(F.array(*[F.slice(F.regexp_extract_all(t, F.lit(x), F.lit(0)), 1, 2) for x in p.templates])), 1, 5)


def template_rule(matches: Column, marketing: Column) -> Column:
    severity = F.when(marketing.isNotNull(), F.least(marketing["severity"] * 0.3 + 0.7, F.lit(1.0))).otherwise(0.7)
    said = F.when(marketing.isNotNull(), "检测到模板化内容 (伴随营销词)").otherwise("检测到模板化内容")
    return F.when(F.size(matches) > 0, anomaly("template_content", said, severity, matches=F.array_join(matches, "|"), stacked=marketing.isNotNull()))


def punctuation_rule(f: Column) -> Column:
    """Of ``text.mark_counts``."""
    share = f["punctuation_count"] / f["length"]
    loud = anomaly("excessive_exclamation", F.format_string("感叹号过多: %d个", f["exclamation_count"]), 0.4, count=f["exclamation_count"])
    much = anomaly("excessive_punctuation", F.format_string("标点符号比例异常: %.1f%%", share * 100), 0.3, ratio=share)
    return F.when(f["exclamation_count"] > 5, loud).when((f["length"] > 0) & (share > 0.2), much)


def analyze(df: DataFrame, p: Params = DEFAULT, text: str = "text") -> DataFrame:
    """Adds ``text_anomalies``, ``text_score`` and ``marketing_count``."""
    t = F.col(text)
    df = df.withColumn("_found", keywords.matches(t, marketing_words(p)))
    df = df.withColumns({"_stats": marketing_stats(t, F.col("_found"), p), "_matches": template_matches(t, p), "_marks": tx.mark_counts(t)})
    df = df.withColumn("_marketing", marketing_rule(F.col("_stats")))
    m = F.col("_marketing")
    found = F.array_compact(F.array(length_rule(t, p), stuffing_rule(t), m, template_rule(F.col("_matches"), m), punctuation_rule(F.col("_marks"))))
    df = df.withColumns({"text_anomalies": found, "marketing_count": F.when(m.isNotNull(), F.col("_stats.count")).otherwise(0)})
    return df.withColumn("text_score", scoring.union(F.transform("text_anomalies", lambda a: a["severity"]))).drop("_found", "_stats", "_matches", "_marks", "_marketing")
