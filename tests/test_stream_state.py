"""Streams in several batches, with restarts in between, against the batch path and plain loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import dedup
from fieldtrust.params import Params
from fieldtrust.streaming import detect, state

LONG = ["the cat sat on the mat and looked at the moon all night", "quite another report about a bakery near the old bridge", "第三家店的味道不错服务员态度也挺好的下次还会再来吃饭的"]


@pytest.fixture(autouse=True)
def store(spark):
    for k, v in state.CONF.items():
        spark.conf.set(k, v)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # each is a worker for each stateful step of each batch
    yield
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    for k in state.CONF:
        spark.conf.unset(k)


def message(i, t, text, device="d", lat=39.9, lon=116.4):
    return json.dumps({"request_id": f"q{i:03d}", "timestamp": "", "data": {"device_id": device, "user_id": "u", "timestamp": 100_000 + t, "geo": {"latitude": lat, "longitude": lon}, "content": {"text": text}}})


def run(spark, tmp_path, frame, batches, name="x"):
    """Each batch as a file and a query of its own, which ends and starts again from its checkpoint."""
    (tmp_path / "in").mkdir(exist_ok=True)
    for n, lines in enumerate(batches):
        (tmp_path / f"in/{name}{n}.txt").write_text("\n".join(lines))
        lines = spark.readStream.schema("value string").text(str(tmp_path / "in"))
        detect.write_batches(frame(lines), str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def texts():
    out = []
    for i in range(36):
        t = LONG[i % 3]
        out.append(t if i % 4 else t[:-1] + "!" if i % 8 else "short one" if i % 16 else t[:19])
    return out


def test_copies_over_three_batches_are_those_of_the_batch_path(spark, tmp_path):
    rows = texts()
    got = run(spark, tmp_path, lambda x: state.with_copies(detect.once(detect.parsed(x)[0]), blocks=3), [[message(i, i, rows[i]) for i in range(a, a + 12)] for a in (0, 12, 24)])
    want = dedup.check_prior(spark.createDataFrame(list(enumerate(rows)), "seq long, text string")).orderBy("seq").collect()
    got = sorted(got, key=lambda r: r.request_id)
    assert [(r.similar_records, r.hamming_distance, r.simhash_score) for r in got] == [(r.similar_records, r.hamming_distance, r.simhash_score) for r in want]
    assert max(r.similar_records for r in got) > 5 and min(r.similar_records for r in got) == 0
    h = np.zeros((len(rows), 256))
    for i, t in enumerate(rows):
        np.add.at(h[i], [ord(c) % 256 for c in t], 1)
    h /= np.linalg.norm(h, axis=1, keepdims=True)
    like = h @ h.T >= Params().cosine
    assert [r.cluster_size for r in got] == [1 + int(like[i, :i].sum()) for i in range(len(rows))]


def test_detection_sees_copies_and_takes_a_request_once(spark, tmp_path):
    text = LONG[0] * 2
    first = [message(i, 60 * i, text, f"d{i}") for i in range(3)] + ["not json"]
    again = [message(1, 60, text, "d1"), message(3, 200, text, "d3"), message(3, 200, text, "d3")]
    got = {r.request_id: r for r in run(spark, tmp_path, detect.detect, [first, again])}
    assert sorted(got) == ["q000", "q001", "q002", "q003"]
    assert not any("重复" in x for x in got["q000"].reasons) and any("3条记录" in x for x in got["q003"].reasons)


def test_both_sinks_of_one_query(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join([message(1, 0, LONG[0]), "not json", '{"request_id": "x"}']))
    lines = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    detect.write_both(detect.detect_with_dead_letters(lines, blocks=2), str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "ck"), availableNow=True).awaitTermination(120)
    assert [r.request_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["q001"]
    assert sorted(r.dead for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == ["not json", '{"request_id": "x"}']


def test_late_rows_and_old_state_go_by_event_time(spark, tmp_path):
    def frame(x):
        return state.with_copies(state.with_device_state(detect.once(detect.parsed(x)[0], "1 minute")), seconds=1000.0, blocks=1).select("request_id", "hour_count", "prev_ts", "similar_records", "cluster_size")

    batches = [[message(0, 1000, LONG[0])], [message(1, 1500, LONG[0])], [message(2, 50_000, LONG[1])], [message(3, 1600, LONG[0])], [message(4, 50_010, LONG[0]), message(5, 50_020, LONG[1])]]
    got = {r.request_id: r for r in run(spark, tmp_path, frame, batches)}
    assert "q003" not in got  # later than the watermark
    assert (got["q001"].similar_records, got["q001"].cluster_size, got["q001"].hour_count, got["q001"].prev_ts) == (1, 2, 2, 101_000)
    assert (got["q002"].hour_count, got["q002"].similar_records) == (1, 0)
    assert got["q004"].similar_records == 0 and got["q005"].similar_records == 1  # of what came over a thousand seconds before nothing is known


def test_sessions(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "device_id string, t long").select("device_id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        s = spark.readStream.schema("device_id string, ts timestamp").parquet(str(tmp_path / "e"))
        detect.write_batches(detect.sessions(s, gap="100 seconds", late="50 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination(120)

    put("a", [("a", 1000), ("a", 1080), ("b", 1010), ("a", 1300)])
    put("b", [("a", 1310), ("a", 9000)])
    put("c", [("a", 1200), ("b", 9010), ("z", 99_000)])  # the first is later than the watermark
    got = sorted((r.device_id, r["first"].timestamp(), r["last"].timestamp(), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1000, 1080, 2), ("a", 1300, 1310, 2), ("a", 9000, 9000, 1), ("b", 1010, 1010, 1), ("b", 9010, 9010, 1)]
