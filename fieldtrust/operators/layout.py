"""How rows are dealt to tasks: small files over all cores, and running counts of hot keys over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEQ_BLOCK = 1 << 17


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by key over the cores where it comes in fewer parts than there are, as a small file of one row group does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def running_count(df: DataFrame, keys: list, order: str, name: str, block: int = SEQ_BLOCK) -> DataFrame:
    """Adds ``name``: which row of its key each is in the order of ``order`` (a unique long), from 1; null keys are one key.

    Rows are ranked within blocks of ``order`` and the blocks' counts summed, so that the rows of one key are spread over its blocks.
    """
    own = df.select("*", F.struct(*keys).alias("_key"), F.floor(F.col(order) / block).alias("_block"))
    inside = F.row_number().over(Window.partitionBy("_key", "_block").orderBy(order))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    cells = own.groupBy("_key", "_block").agg(F.count("*").alias("_n")).select("_key", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    out = own.withColumn(name, inside).join(cells, ["_key", "_block"])
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_key", "_block", "_before")
