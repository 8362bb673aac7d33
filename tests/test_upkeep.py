"""Rollups by increments and metrics of running queries."""

from pyspark.sql import functions as F

from fieldtrust.operators import metrics, rollups
from fieldtrust.plans import tables as t


def test_increments_add_up(spark, sf_dir, tmp_path):
    d = t.detections(spark, sf_dir).where("id < 600")
    path = str(tmp_path / "r")
    rollups.apply_increment(path, "a", d.where("id < 300"))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "r/day").iterdir() if p.is_dir()}
    day = d.agg(F.max(F.to_date("created_at"))).first()[0]
    late = d.where("id >= 300").withColumn("created_at", F.lit(day).cast("timestamp"))
    rollups.apply_increment(path, "b", late)
    rollups.apply_increment(path, "b", late)  # done again
    got = sorted(map(tuple, rollups.rollup(spark, path).select("tenant_id", "stat_date", "total_records", "avg_suspicion_score").collect()))
    whole = rollups.finished(rollups.partials(d.where("id < 300").unionByName(late)))
    assert got == sorted(map(tuple, whole.select("tenant_id", "stat_date", "total_records", "avg_suspicion_score").collect()))
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "r/day").iterdir() if p.is_dir()}
    assert [k for k in before if after[k] != before[k]] in ([], [f"_day={day}"])  # other days are not touched
    calls = spark.createDataFrame([(9, 500)], "tenant_id long, status int").withColumn("created_at", F.lit("2030-01-01").cast("timestamp"))
    rollups.apply_increment(path, "c", None, calls)
    r = rollups.rollup(spark, path).where("tenant_id = 9").first()
    assert (r.api_calls, r.api_errors, r.total_records, r.avg_suspicion_score) == (1, 1, 0, None)


def test_observed_metrics_are_those_of_the_aggregate(spark, sf_dir, tmp_path):
    d = t.detections(spark, sf_dir)
    df, seen = metrics.observed(d)
    df.write.parquet(str(tmp_path / "d"))
    key = lambda rows: sorted((m, sorted(x.items()), v) for m, x, v in rows)
    want = key(map(tuple, metrics.detection_metrics(d).collect()))
    assert key(metrics.rows_of(seen.get)) == want
    text = metrics.exposition(metrics.rows_of(seen.get))
    assert 'detection_duration_seconds_bucket{le="+Inf"}' in text and metrics.as_table(spark, metrics.rows_of(seen.get)).count() == len(want)
    # the same rows as a stream of two batches
    said = metrics.StreamMetrics()
    spark.streams.addListener(said)
    try:
        d.repartition(2).write.parquet(str(tmp_path / "s"))
        s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
        metrics.watched(s).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start().awaitTermination(60)
        for _ in range(50):  # reports arrive behind the query
            if said.batches >= 2:
                break
            __import__("time").sleep(0.2)
        rows = said.rows()
    finally:
        spark.streams.removeListener(said)
    assert key(r for r in rows if r[0].startswith("detection_")) == want
    assert ("batches_total", {}, 2.0) in rows and ("input_rows_total", {}, float(d.count())) in rows and ("query_failures_total", {}, 0.0) in rows
