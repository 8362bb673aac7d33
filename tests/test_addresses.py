"""The likest addresses against all pairs of the column expression."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtrust.operators import address, graph

PLACES = ["北京市朝阳区", "北京市海淀区", "广东省深圳市南山区", "广东省广州市天河区", "四川省成都市武侯区", "江苏省苏州市", "上海浦东新区", "杭州", "", "无名"]
STREETS = ["建国路", "世纪大道", "人民南路", "科技园路", "花园街", ""]
HOUSES = ["SOHO大厦", "翠园小区", "中心广场", "", ""]


def made(n, seed, key):
    rng = random.Random(seed)
    rows = [(i, rng.choice(PLACES) + rng.choice(STREETS) + (f"{rng.randrange(40)}号" if rng.random() < 0.7 else "") + rng.choice(HOUSES)) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[0][1])], f"{key} long, address string"


def all_pairs(df, candidates, k):
    graph.checkpoint_dir(df.sparkSession)
    a, b = address.parse(df, to="a").checkpoint(), address.parse(candidates, to="b").checkpoint()
    s = a.crossJoin(b).select("record_id", "candidate_id", address.similarity(F.col("a"), F.col("b")).alias("similarity"))
    w = Window.partitionBy("record_id").orderBy(F.col("similarity").desc(), "candidate_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def test_top_k_of_all_pairs(spark):
    df, c = spark.createDataFrame(*made(60, 1, "record_id")), spark.createDataFrame(*made(150, 2, "candidate_id"))
    for k, tile in ((3, 512), (5, 4)):
        got = address.similar_addresses(df, c, k, tile=tile)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, all_pairs(df, c, k).collect()))
    assert address.similar_addresses(df, c.where("false")).count() == 0 and address.similar_addresses(df.where("false"), c).count() == 0


def test_few_pairs_are_compared(spark):
    df, c = spark.createDataFrame(*made(300, 3, "record_id")), spark.createDataFrame(*made(600, 4, "candidate_id"))
    report = {}
    got = address.similar_addresses(df, c, 3, report=report)
    assert got.count() == 3 * 303 and report["pairs"] == 303 * 603
    print(report)
    assert report["compared"] < 0.5 * report["pairs"]


def test_ids_of_any_kind(spark):
    df = spark.createDataFrame([("a", "北京市朝阳区建国路1号")], "record_id string, address string")
    c = spark.createDataFrame([("z", "北京市朝阳区建国路1号"), ("b", "北京市朝阳区建国路1号"), (None, "北京市朝阳区建国路1号"), ("q", "上海")], "candidate_id string, address string")
    assert [r.candidate_id for r in address.similar_addresses(df, c, 2).orderBy("rank").collect()] == ["b", "z"]
