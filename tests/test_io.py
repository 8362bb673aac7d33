"""Files, streams and models there and back."""

import json

import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import decision, geo_rules, keywords, ml, text_rules
from fieldtrust.sources import generators, readers, writers
from fieldtrust.streaming import detect, state


def test_csv_encodings(spark, tmp_path):
    for e in ("utf-8", "gbk"):
        (tmp_path / f"{e}.csv").write_bytes("名称,纬度,经度\n书店,39.9,116.4\n".encode(e))
        df = readers.with_known_headings(readers.read_any(spark, str(tmp_path / f"{e}.csv")))
        assert df.collect()[0].asDict() == {"name": "书店", "latitude": "39.9", "longitude": "116.4"}
    with pytest.raises(ValueError):
        readers.with_known_headings(df.drop("latitude"))
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.txt")


def test_json_shapes(spark, tmp_path):
    rows = [{"id": 1, "text": "a"}, {"id": 2, "text": "b"}]
    for i, shape in enumerate((rows, {"data": rows}, {"data": rows[0]}, rows[0])):
        p = tmp_path / f"{i}.json"
        p.write_text(json.dumps(shape))
        assert readers.read_json(spark, str(p)).count() == (2 if i < 2 else 1)


def test_features_and_logs(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"feature_id": "x", "patterns": ["a", "b"], "is_active": True}]}))
    f = readers.read_features(spark, str(tmp_path / "f.json"))
    assert f.first().patterns == ["a", "b"]
    got = keywords.match_features(spark.createDataFrame([(1, "A b"), (2, "z")], "id int, text string"), f).collect()
    assert [(r.id, r.n_patterns) for r in got] == [(1, 2)]
    (tmp_path / "x.log").write_text("".join(f"{'ERROR' if i % 2 else 'INFO'} {i}\n" for i in range(10)))
    assert [r.value for r in readers.log_tail(spark, str(tmp_path / "x.log"), 3, "ERROR").collect()] == ["ERROR 7", "ERROR 9"]


def test_sinks(spark, tmp_path):
    scored = decision.score(text_rules.analyze(geo_rules.analyze(generators.records(spark, 20, 5))))
    rows = writers.to_detections(scored, 3, "2024-01-02").withColumn("id", F.col("seq"))
    writers.append_detections(rows.drop("geo_anomalies", "text_anomalies"), str(tmp_path / "d"))
    back = readers.read_tenant(spark, str(tmp_path / "d"), 3)
    assert back.count() == 25 and readers.read_tenant(spark, str(tmp_path / "d"), 4).count() == 0
    writers.export_records(back.select("id", "record_id", "reasons", "created_at"), str(tmp_path / "e"), 10)
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 10
    writers.export(back.select("id", "reasons"), str(tmp_path / "c"), "csv")
    with pytest.raises(ValueError):
        writers.export(back, str(tmp_path / "z"), "pdf")
    assert writers.flush_log(back, str(tmp_path / "l"), 10) and not writers.flush_log(back, str(tmp_path / "l"), 100)


def test_stream(spark, tmp_path):
    for k, v in state.CONF.items():
        spark.conf.set(k, v)

    def message(i, device, t, lat, lon, text="今天和朋友过来吃饭，味道不错。"):
        return json.dumps({"request_id": f"q{i}", "timestamp": "", "data": {"device_id": device, "user_id": "u", "timestamp": t, "geo": {"latitude": lat, "longitude": lon}, "content": {"text": text}}})

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join([message(1, "a", 1000, 39.9, 116.4), "not json", message(2, "b", 1000, 200.0, 10.0)]))
    lines = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    for part in ("a", "b"):
        if part == "b":
            (tmp_path / "in/b.txt").write_text(message(3, "a", 1030, 31.2, 121.4))
        assert detect.write_batches(detect.detect(lines), str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination(60)
    got = {r.request_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"q1", "q2", "q3"} and not got["q1"].is_fake and got["q2"].is_fake
    assert got["q3"].is_fake and "瞬移" in got["q3"].reasons[0]
    _, dead = detect.parsed(spark.read.text(str(tmp_path / "in")))
    assert [r.value for r in dead.collect()] == ["not json"]


def test_stream_windows(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:00:50"), ("a", "2024-01-01 00:01:10")], "device_id string, t string").select("device_id", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "e"))
    q = detect.windowed(spark.readStream.schema("device_id string, ts timestamp").parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "k")).start()
    q.processAllAvailable()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]
    q.stop()


def test_model_there_and_back(spark, tmp_path):
    rows = ml.hybrid_features(decision.score(text_rules.analyze(geo_rules.analyze(generators.training(spark, 300)))))
    rows = rows.withColumn("label", (F.col("label") == "fake").cast("int"))
    train, test = ml.stratified_split(rows, "record_id")
    model = ml.train(train, "mlp", seed=1)
    m = ml.evaluate(ml.predict(model, test), test.select("record_id", "label"), "record_id").first()
    assert m.f1 > 0.8
    ml.save(model, str(tmp_path / "m"))
    again = ml.predict(ml.load(spark, str(tmp_path / "m")), test).select("record_id", "predicted").collect()
    assert sorted(again) == sorted(ml.predict(model, test).select("record_id", "predicted").collect())
    r = ml.Registry()
    r.register("a", model)
    assert r.predict(test).count() == test.count()
    with pytest.raises(KeyError):
        r.set_active("b")
