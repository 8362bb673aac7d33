"""Hot keys over blocks, fingerprints by definition, leaders by brute force, and the small operators."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import address, cluster, dedup, graph, layout, output, reports
from fieldtrust.sources import generators, readers


def test_running_count_of_hot_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "cold", None])) for i in rng.sample(range(3000), 800)]
    got = {r.seq: r.n for r in layout.running_count(spark.createDataFrame(rows, "seq long, k string"), ["k"], "seq", "n", block=100).collect()}
    seen, want = {}, {}
    for i, k in sorted(rows):
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert got == want


def test_fingerprint_by_definition():
    def plain(t):
        grams = [t[i : i + 2] for i in range(len(t) - 1)] if len(t) > 1 else [t] * bool(t)
        h = [int(hashlib.md5(g.encode()).hexdigest()[16:], 16) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    hashes = dedup._PairHashes()
    for t in ("", "a", "ab", "这家店真的很不错", "naïve 😀😀", "a b" * 90):
        assert dedup.majority_bits(t, hashes) == plain(t), t


@pytest.mark.parametrize("block", [7, 1 << 17])
def test_prior_rows_by_brute_force(spark, block):
    rng = random.Random(3)
    base = ["一" * 30 + str(i) * 3 for i in range(4)] + ["short", ""]
    rows = [(i * 3, rng.choice(base)) for i in range(60)] + [(500, None)]
    got = {r.seq: (r.similar_records, r.hamming_distance) for r in dedup.check_prior(spark.createDataFrame(rows, "seq long, text string"), block=block).collect()}
    hashes = dedup._PairHashes()
    fp = {i: dedup.majority_bits(t or "", hashes) for i, t in rows}
    for i, t in rows:
        near = [d for j, _ in rows if j < i and (d := (fp[i] ^ fp[j]).bit_count()) <= (0 if len(t or "") < 20 else 3)]
        assert got[i] == (len(near), min(near, default=64))


def test_leaders_in_order(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(80, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {r.seq: r.leader for r in cluster.leaders(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "seq long, vector array<double>"), 0.8).collect()}
    want = {}
    for i in range(80):
        want[i] = next((j for j in range(i) if want[j] == j and v[i] @ v[j] >= 0.8), i)
    assert got == want and len(set(want.values())) < 40


def test_similar_addresses_in_tiles(spark):
    df = spark.createDataFrame([(i, "北京市朝阳区建国路%d号" % i) for i in range(9)], "record_id long, address string")
    c = spark.createDataFrame([(i, "北京市朝阳区建国路%d号" % i) for i in range(30)], "candidate_id long, address string")
    whole = address.similar_addresses(df, c, 2).orderBy("record_id", "rank").collect()
    assert whole == address.similar_addresses(df, c, 2, tile=2).orderBy("record_id", "rank").collect() and len(whole) == 18
    assert {r.record_id for r in whole if r["rank"] == 1 and r.candidate_id == r.record_id} == set(range(9))


def test_scratch_needs_a_shared_folder_off_local():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        graph.checkpoint_dir(Session())


def test_small_operators(spark, tmp_path):
    (tmp_path / "system_config.json").write_text(json.dumps({"configs": [{"config_key": "a", "config_value": "1"}, {"config_key": "b", "config_value": "2", "category": "x", "is_editable": False}]}))
    rows = {r.config_key: r for r in readers.read_configs(spark, str(tmp_path / "system_config.json")).collect()}
    assert rows["a"].category == "general" and rows["a"].is_editable and not rows["b"].is_editable and rows["b"].description == ""
    p = generators.places(spark, 6).collect()
    assert [r.label for r in p] == ["fake"] * 3 + ["normal"] * 3 and all(39.8 <= r.latitude <= 40.0 for r in p)
    assert all(r.label == "normal" for r in generators.places(spark, 4, include_fake=False).collect())
    m = generators.random_matrix(spark, 50).collect()
    assert all(len(r.x) == 10 and r.y == int(any(v > 0.6 for v in r.x[:3])) for r in m) and 0 < sum(r.y for r in m) < 50
    line = reports.metrics_line("forest", spark.createDataFrame([(9, 0.5, 1.0, 0.25, 0.4), (0, 0.0, 0.0, 0.0, 0.0)], "sample_count int, accuracy double, precision double, recall double, f1 double")).orderBy(F.desc("sample_count")).collect()
    assert line[0].line == "forest" + " " * 19 + "样本=9      Acc=0.5000  P=1.0000  R=0.2500  F1=0.4000" and "样本不足" in line[1].line
    r = spark.createDataFrame([(0, "x"), (1, "y")], "seq long, record_id string")
    placed = output.with_places(r, spark.createDataFrame([(0, 1.0, 2.0)], "seq long, latitude double, longitude double")).orderBy("seq").collect()
    assert placed[0].latitude == 1.0 and placed[1].latitude is None
