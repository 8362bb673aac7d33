"""Connected components by star contraction."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder that the cluster names. One of our own only on a ``local`` master: elsewhere other machines would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="fieldtrust-"))
    return sc.getCheckpointDir()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``: the least node that each reaches. Every round is checkpointed."""
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct().checkpoint()
    last = None
    for _ in range(rounds):
        sides = e.unionAll(e.select(F.col("lo"), F.col("hi")).toDF("hi", "lo"))
        # larger neighbours move to the least one seen
        least = sides.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        e = sides.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        # then the smaller ones
        least = e.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = e.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == last:
            roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
        last = now
    raise RuntimeError("components did not settle")
