"""Joins of tables that grow with the input are not sent through the driver, however small their files."""

from pyspark.sql import functions as F

from fieldtrust.operators import spatial
from fieldtrust.plans import registry


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_densities_broadcast_nothing(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("record_id"), (31 + F.col("id") % 20 / 1000).alias("latitude"), (121 + F.col("id") % 7 / 1000).alias("longitude")).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    assert "Broadcast" not in plans(spatial.counts_within(p, p))
    assert "Broadcast" not in plans(spatial.spatial_density(p, p))


def test_density_query_broadcasts_nothing(spark, sf_dir):
    assert "Broadcast" not in plans(registry.QUERIES["report_density"](spark, sf_dir))
