"""What a vector is sent to does not grow with the vectors, and a task holds some rows' cosines at a time."""

from pyspark.sql import functions as F

from fieldtrust.operators import cluster
from fieldtrust.operators.graph import components
from tests.test_near_blocks import brute, frame, points


def test_blocks_grow_with_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCKS", 4, raising=False)
    x = points(6, 5, 200, 8)
    blocks = cluster.blocked(frame(spark, x), "seq", "vector", rows=20, pivots=4)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert sum(sizes) == len(x) and len(sizes) <= 16  # 50 of twenty rows


def test_floats_are_sent_as_floats(spark):
    df = frame(spark, points(7, 3, 10, 4)).withColumn("vector", F.col("vector").cast("array<float>"))
    assert dict(cluster.blocked(df, "seq", "vector").dtypes)["v"] == "array<float>"


def test_pairs_and_links_by_strips_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cluster, "COSINES", 64, raising=False)
    monkeypatch.setattr(cluster.blocked, "__defaults__", (16, 8))
    x = points(8, 6, 20, 8)
    want = brute(x, 0.9)
    assert {(r.a, r.b) for r in cluster.similar_pairs(frame(spark, x), 0.9).collect()} == want
    pairs = spark.createDataFrame(sorted((int(a), int(b)) for a, b in want), "a long, b long")
    by = lambda e: sorted(map(tuple, components(e).collect()))
    assert by(cluster.links(frame(spark, x), 0.9)) == by(pairs)
    top = {r.seq: (r.cluster_size, list(r.similar_ids)) for r in cluster.prior_clusters(frame(spark, x), key="seq").collect()}
    monkeypatch.setattr(cluster, "COSINES", 1 << 22)
    assert {r.seq: (r.cluster_size, list(r.similar_ids)) for r in cluster.prior_clusters(frame(spark, x), key="seq").collect()} == top
