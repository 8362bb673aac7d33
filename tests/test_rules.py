"""Rules on small inputs, and windows and joins against row-by-row evaluation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldtrust.functions import geo, hashing, scoring
from fieldtrust.functions import text as tx
from fieldtrust.operators import address, crossval, decision, dedup, geo_rules, preprocess, records, spatial, text_rules, workflow
from fieldtrust.params import Params
from fieldtrust.sources import generators

HYPE = "超级推荐！必去必买，绝绝子！全网第一，限时优惠，手慢无"
PLAIN = "今天和朋友过来吃饭，菜的味道不错，服务员态度也挺好的。"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def score(spark, rows, params=Params()):
    """(text, lat, lon, device, t) rows through the whole batch path."""
    df = spark.createDataFrame([(f"r{i}", i, *r) for i, r in enumerate(rows)], "record_id string, seq long, text string, latitude double, longitude double, device_id string, timestamp double")
    df = dedup.check_prior(text_rules.analyze(geo_rules.analyze(df, params), params), params)
    return sorted(decision.score(df, params).collect(), key=lambda r: r.seq)


def test_severities(spark):
    u = lambda *s: one(spark, scoring.union(F.array(*map(F.lit, s)) if s else F.array().cast("array<double>"))).c0
    assert u(0.6) == 60.0 and u() == 0.0 and u(1.0, 1.0, 1.0) == 100.0
    assert u(0.3) < u(0.3, 0.3) < u(0.3, 0.3, 0.3) == 65.7


def test_rounding_is_of_the_binary_value(spark):
    xs = [2.675, 0.125, 0.005, 1.005, 99.995, 0.015, 50.0, 33.335, 0.375, 1e-5, 100.0] + [random.Random(1).random() * 100 for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scoring.round_half_even(F.col("x"), 2).alias("y")).collect()
    assert [r.y for r in got] == [round(r.x, 2) for r in got]


def test_places(spark):
    L = F.lit
    assert one(spark, geo.is_valid(L(200.0), L(500.0)), geo.is_valid(L(float("nan")), L(0.0)), geo.is_valid(L(90.0), L(-180.0))) == (False, False, True)
    far = lambda a, b: one(spark, geo_rules.out_of_range(L(a), L(b)).isNotNull()).c0
    assert far(45.0, -100.0) and far(0.0, 0.0) and not far(40.0, 116.0) and not far(51.5, -0.1)
    assert one(spark, geo.speed_kmh(L(1.0), L(0.0)), geo.speed_kmh(L(0.0), L(0.0)), geo.speed_kmh(L(100.0), L(-3600.0))) == (math.inf, 0.0, 100.0)
    lat, lon = geo.wgs84_to_gcj02(L(39.9), L(116.4))
    back = geo.gcj02_to_wgs84(lat, lon)
    r = one(spark, lat, lon, *back, *geo.bd09_to_gcj02(*geo.gcj02_to_bd09(L(39.9), L(116.4))))
    assert abs(r.c0 - 39.9014) < 2e-4 and abs(r.c1 - 116.40624) < 2e-4 and abs(r.c2 - 39.9) < 1e-4 and abs(r.c4 - 39.9) < 1e-5
    assert one(spark, spatial.nearest_city(L(39.95), L(116.4)), spatial.containing_city(L(31.3), L(121.5)), spatial.nearest_city(L(0.0), L(0.0)), spatial.place_type(L(22.3001), L(114.2))) == ("北京", "上海", None, "water")
    assert one(spark, geo.decimals(L(39.9042)), geo.precision(L(39.9), L(116.4))["level"]) == (4, "low")


def test_text_rules(spark):
    rows = [(PLAIN,), (HYPE,), ("短",), ("好" * 4 + "吃的东西真是多",), ("字" * 600,), ("很好!!!!!!",), (None,), ("环境环境很好的地方",), ("，。！？、；：" * 3,)]
    got = text_rules.analyze(spark.createDataFrame(rows, "text string")).collect()
    kinds = [[a.type for a in r.text_anomalies] for r in got]
    assert kinds[0] == [] and got[0].text_score < 50
    assert kinds[1][0] == "high_severity_marketing" and "template_content" in kinds[1]
    assert kinds[2] == ["too_short"] and kinds[6] == ["too_short"] and "keyword_stuffing" in kinds[3] and "too_long" in kinds[4]
    assert "excessive_exclamation" in kinds[5] and "keyword_stuffing" in kinds[7] and "excessive_punctuation" in kinds[8]
    mine = text_rules.analyze(spark.createDataFrame([("这里有独家秘方值得一试",)], "text string"), Params(keywords=("独家秘方",))).first()
    assert [a.type for a in mine.text_anomalies] == ["moderate_marketing"]


def test_decisions(spark):
    got = score(spark, [(PLAIN, 39.9, 116.4, "a", 0.0), (PLAIN + "一", 200.0, 500.0, "b", 0.0), (HYPE, 39.9, 116.4, "c", 0.0), (HYPE + "二三四五六七八九十", -45.0, -100.0, "d", 0.0)])
    assert not got[0].is_fake and got[0].risk_level == "low"
    assert got[1].is_fake and got[1].risk_level == "high" and got[1].forced_high and got[1].geo_score == 100.0 and got[1].confidence >= 0.85
    assert not got[2].is_fake and got[2].risk_level == "medium"
    assert got[3].is_fake and got[3].risk_level != "low"


def test_rate_and_movement(spark):
    got = score(spark, [(PLAIN, 39.9, 116.4, "a", float(t)) for t in range(15)])
    assert got[-1].geo_anomalies[-1].type == "high_frequency_minute" and got[9].geo_anomalies == []
    jumps = geo_rules.analyze(generators.teleports(spark, 4)).where("seq % 2 = 1").collect()
    assert all("teleport" in [a.type for a in r.geo_anomalies] for r in jumps)


def test_duplicates(spark):
    got = score(spark, [(PLAIN, 39.9, 116.4, f"d{i}", 0.0) for i in range(8)] + [("短文", 39.9, 116.4, "x", 0.0), ("短文", 39.9, 116.4, "y", 0.0)])
    assert got[0].simhash_score == 0 and [r.similar_records for r in got[:8]] == list(range(8)) and got[7].simhash_score == 100.0
    assert got[9].similar_records == 1


def test_rates_by_row_loop(spark):
    rng = random.Random(4)
    rows = sorted((rng.randrange(4), rng.randrange(9000)) for _ in range(500))
    rows = [(d, t, i) for i, (d, t) in enumerate(sorted(rows, key=lambda r: r[1]))]
    df = spark.createDataFrame([(f"d{d}", float(t), i) for d, t, i in rows], "device_id string, timestamp double, seq long")
    seen, want = {}, {}
    for d, t, i in rows:
        kept = seen[d] = [x for x in seen.get(d, []) + [t] if x > t - 3600]
        want[i] = (sum(x > t - 60 for x in kept), len(kept))
    assert {r.seq: (r.minute_count, r.hour_count) for r in geo_rules.with_rates(df).collect()} == want
    mixed = [(f"d{rng.randrange(3)}", float(rng.randrange(9000)), i) for i in range(300)]
    seen, want = {}, {}
    for d, t, i in mixed:
        kept = seen[d] = [x for x in seen.get(d, []) + [t] if x > t - 3600]
        want[i] = (sum(x > t - 60 for x in kept), len(kept))
    got = geo_rules.with_rates_by_arrival(spark.createDataFrame(mixed, "device_id string, timestamp double, seq long")).collect()
    assert {r.seq: (r.minute_count, r.hour_count) for r in got} == want


def test_fusion(spark):
    none = "array<string>"
    kind = f"id int, rules struct<suspicion_score:double,is_fake:boolean,confidence:double,high_severity_hit:boolean,reasons:{none}>, cross_validation struct<risk_level:string,confidence:double,risk_reasons:{none}>, ai struct<label:string,confidence:double,risk_factors:{none}>, warnings {none}"
    rows = [
        (1, (40.0, True, 0.6, True, ["a"]), ("low", 0.9, []), ("real", 0.9, ["a", "b"]), ["w", ""]),
        (2, (40.0, False, 0.7, False, []), ("high", 0.8, ["c"]), None, None),
        (3, (10.0, False, 0.9, False, []), None, None, []),
    ]
    r = {x.id: x for x in decision.fuse(spark.createDataFrame(rows, kind)).collect()}
    assert r[1].fused_fake and r[1].fused_risk == "high" and r[1].fused_confidence < 0.75 and r[1].fused_reasons == ["a", "b", "w"]
    assert 40 <= r[2].fused_score <= 85 and abs(sum(w.weight for w in r[2].weights) - 1) < 1e-3 and r[2].weights[0].weight > r[2].weights[1].weight
    assert r[3].fused_label == "real" and r[3].fused_confidence == 0.9


def test_preprocess(spark):
    rows = [("【名店】  全网第一 ", "广东省深圳市南山区科技路1号", "22.5", "113.9", "138-0013-8000", "9:00-22:00"), ("", None, "abc", "1", "12", "23:00-8:00"), ("ok", "x", "95", "10", None, None)]
    got = preprocess.preprocess(spark.createDataFrame(rows, "name string, address string, latitude string, longitude string, phone string, business_hours string")).collect()
    assert got[0].name == "名店 全网第一" and got[0].is_valid and got[0].address_parts.province == "广东省" and got[0].address_parts.number == "1号" and len(got[0].warnings) == 2
    assert not got[1].is_valid and "坐标格式错误" in got[1].errors and any("电话" in w for w in got[1].warnings) and any("营业时间" in w for w in got[1].warnings)
    assert not got[2].is_valid and got[2].latitude == 95.0
    c = spark.createDataFrame([("很 好 吃！！！啊啊啊啊啊啊",), ("短",)], "t string").select(preprocess.clean_text(F.col("t")).alias("c")).select("c.*").collect()
    assert c[0].text == "很好吃啊" or c[0].text.startswith("很好吃") and c[1].text == ""
    assert one(spark, tx.phone(F.lit("400-123-4567"))["kind"], tx.phone(F.lit("010-12345678"))["kind"], tx.phone(F.lit("5"))["valid"]) == ("service", "landline", False)


def test_addresses(spark):
    df = spark.createDataFrame([(1, "北京市朝阳区建国路88号SOHO大厦"), (2, "广东省深圳市科技园路1号"), (3, None)], "record_id int, address string")
    p = {r.record_id: r.parsed for r in address.parse(df).collect()}
    assert p[1].province.value == "北京" and p[1].district.value == "朝阳区" and p[1].street.value == "建国路" and p[1].number.value == "88号" and p[1].is_complete
    assert p[2].province.value == "广东" and p[3].confidence == 0.0 and p[3].full_address == ""
    s = {r.record_id: r.parsed for r in address.short_parse(df).collect()}
    assert s[1].province == "北京市" and s[3].warnings == ["地址文本为空或过短"]
    near = address.similar_addresses(df.where("record_id = 1"), df.where("record_id < 3").withColumnRenamed("record_id", "candidate_id"), 1).collect()
    assert [r.candidate_id for r in near] == [1]
    assert one(spark, tx.positional_similarity(F.lit("abcd"), F.lit("abxd")), tx.positional_similarity(F.lit("ab"), F.lit("abcd")), tx.positional_similarity(F.lit(""), F.lit("a"))) == (0.75, 1.0, 0.0)


def test_cross_validation(spark):
    rows = [("a", "osm", True, 0.9, 39.9, 116.4), ("a", "amap", True, 0.8, 39.91, 116.4), ("b", "osm", True, 1.0, 1.0, 1.0), ("b", "amap", False, 0.0, 0.0, 0.0), ("c", "osm", False, 0.0, 0.0, 0.0)]
    got = {r.record_id: r for r in crossval.validate(spark.createDataFrame(rows, "record_id string, platform string, found boolean, similarity double, latitude double, longitude double")).collect()}
    assert (got["a"].risk_level, got["b"].risk_level, got["c"].risk_level) == ("low", "medium", "high") and len(got["a"].risk_reasons) == 1
    assert abs(got["a"].confidence - (0.6 + 0.85 * 0.4)) < 1e-9 and not got["c"].is_valid
    s = spark.createDataFrame([("Cafe One", "cafe one "), ("ab", "xaby"), ("abcd", "abxd"), ("", "a")], "a string, b string").select(crossval.name_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in s] == [1.0, 0.9, 0.75, 0.0]


def test_records_and_state(spark):
    nested = spark.createDataFrame([("1", (1.0, 2.0), ("t",), None), ("2", None, None, 5.0)], "id string, geo struct<latitude:double,longitude:double>, content struct<text:string>, latitude double")
    got = records.normalized(nested).collect()
    assert (got[0].latitude, got[0].longitude, got[0].text, got[1].latitude, got[1].text) == (1.0, 2.0, "t", 5.0, "")
    ev = spark.createDataFrame([("r1", 1, "approve", "u", None), ("r1", 2, "label", "u", "fake"), ("r2", 1, "delete", "u", None), ("r1", 3, "escalate", "v", None)], "record_id string, seq int, action string, reviewer string, value string")
    st = {r.record_id: r for r in workflow.review_state(spark.createDataFrame([("r1",), ("r2",), ("r3",)], "record_id string"), ev).collect()}
    assert set(st) == {"r1", "r3"} and st["r1"].review_status == "escalated" and st["r1"].ground_truth == "fake" and st["r3"].review_status == "pending"
    assert one(spark, hashing.polynomial31(F.lit("ab"))).c0 == 97 * 31 + 98
    words = spark.createDataFrame([("好吃，好吃。不错的；好吃",)], "t string").select(tx.top_keywords(F.col("t"), 2).alias("k")).first().k
    assert words == ["好吃", "不错的"]


def test_generators_repeat(spark):
    a, b = (generators.training(spark, 200).collect() for _ in range(2))
    assert a == b and {r.stratum for r in a} == {"normal", "marketing", "geo", "mixed", "boundary"}
    got = decision.score(text_rules.analyze(geo_rules.analyze(generators.records(spark, 30, 30, geo_share=1.0)))).collect()
    assert all(r.is_fake == (r.label == "fake") for r in got)


@pytest.mark.parametrize("radius", [1000.0, 40_000.0])
def test_neighbours_by_brute_force(spark, radius):
    rng = random.Random(6)
    pts = [(i, rng.choice([0.0, 40.0, 79.0]) + rng.random() / 2, rng.choice([-179.95, 10.0, 179.9]) + rng.random() / 10) for i in range(150)]
    df = spark.createDataFrame(pts, "record_id long, latitude double, longitude double")

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))

    want = {(a[0], b[0]) for a in pts for b in pts if metres(a, b) <= radius}
    got = {(r.record_id, r.other_id) for r in spatial.neighbours(df, df.withColumnRenamed("record_id", "other_id"), radius).collect()}
    assert got == want
