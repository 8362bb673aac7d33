"""Rows of a group cut into tiles along one coordinate, and the pairs of tiles that can hold pairs of rows.

Rows are counted by whole bins of the coordinate; bins follow each other in tiles of about ``rows`` rows, and a bin that holds
more by itself is dealt to several tiles by a hash. So no task ever holds a whole group, however large or narrow it is, and tiles
whose coordinates are further apart than the reach never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tiled(df: DataFrame, keys: list[str], bin_: str, ident: Column, rows: int) -> DataFrame:
    """``df`` with ``tile``, a struct that orders the tiles of a group; a group has as many counts as bins, so bins must be few."""
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1))
    counts = df.groupBy(*keys, bin_).agg(F.count("*").alias("_n")).withColumn("_from", F.floor(F.coalesce(before, F.lit(0)) / rows))
    parts = F.ceil(F.col("_n") / rows)
    wide = parts > 1
    tile = F.struct(F.col("_from").alias("at"), F.when(wide, F.col(bin_)).otherwise(-1).alias("bin"), F.when(wide, F.pmod(F.xxhash64(ident), parts)).otherwise(0).alias("part"))
    return df.join(counts, [*keys, bin_]).withColumn("tile", tile).drop("_n", "_from")


def tile_pairs(tiles: DataFrame, keys: list[str], coordinate: str, reach: float) -> DataFrame:
    """``(keys..., ta, tb)``, ta <= tb, of tiles whose coordinates come within ``reach``."""
    spans = tiles.groupBy(*keys, "tile").agg(F.min(coordinate).alias("lo"), F.max(coordinate).alias("hi"))
    a = spans.select(*keys, F.col("tile").alias("ta"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("tile").alias("tb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    same = F.col("ta") <= F.col("tb")
    for k in keys:
        same = (F.col(k) == F.col(f"_{k}")) & same
    near = (F.col("blo") - F.col("ahi") <= reach) & (F.col("alo") - F.col("bhi") <= reach)
    return a.join(b, same & near).select(*keys, "ta", "tb")
