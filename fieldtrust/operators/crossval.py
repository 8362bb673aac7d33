"""Cross-checks against other platforms' rows."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldtrust.functions.text import text_of
from fieldtrust.operators.spatial import platform_spread

COORDINATE_METRES = 500.0
REASONS = {"none": "所有平台均未找到匹配POI，可能是虚构数据", "one": "仅单个平台存在记录，存在虚假风险"}


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-blocks ratio; no built-in has it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def name_similarity(a, b):
    """1 for equal names, 0.9 for one within the other, else the sequence ratio; 0 where one is empty. Case and ends aside."""
    x, y = F.lower(F.trim(text_of(a))), F.lower(F.trim(text_of(b)))
    return F.when((text_of(a) == "") | (text_of(b) == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(sequence_ratio(x, y))


def validate(matches: DataFrame, key: str = "record_id") -> DataFrame:
    """Platform rows ``(key, platform, found, similarity, latitude, longitude)`` to a verdict a record.

    None found: high; one: medium; else low, with the spread of the coordinates as an issue beyond 500 m. Confidence is the
    share of platforms that found it, with 40 % from their similarity where there is one.
    """
    by = matches.groupBy(key).agg(F.count_if("found").alias("n_found"), F.count("*").alias("n_platforms"), F.avg(F.when(F.col("found") & (F.col("similarity") > 0), F.col("similarity"))).alias("sim"))
    out = by.join(platform_spread(matches, key), key, "left")
    issue = F.when((F.col("n_found") > 1) & (F.col("max_metres") > COORDINATE_METRES), F.format_string("多平台坐标差异过大: 最大偏移%.0f米", F.col("max_metres")))
    risk = F.when(F.col("n_found") == 0, "high").when(F.col("n_found") == 1, "medium").otherwise("low")
    why = F.array_compact(F.array(F.when(F.col("n_found") == 0, REASONS["none"]).when(F.col("n_found") == 1, REASONS["one"]), issue))
    base = F.col("n_found") / F.col("n_platforms")
    sure = F.least(F.coalesce(base * 0.6 + F.col("sim") * 0.4, base), F.lit(1.0))
    return out.select(key, "n_found", "n_platforms", risk.alias("risk_level"), sure.alias("confidence"), why.alias("risk_reasons"), (risk != "high").alias("is_valid"))
