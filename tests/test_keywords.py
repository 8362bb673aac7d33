"""Keyword tables against plain counts."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import keywords

TEXTS = ["aaaa banana", "ananas", "", None, "必去必去必买", "aaaa banana", "x" * 50 + "banana"]
WORDS = ["aa", "ana", "banana", "必去", "必去必买", "an", "", None, "zz", "aa", "xxxxxxxx"]


def plain(texts, words):
    words = {w for w in words if w}
    return sorted((i, w, t.count(w)) for i, t in enumerate(texts) for w in words if t and w in t)


@pytest.mark.parametrize("bound", [100, 0])
def test_hits_are_plain_counts(spark, bound):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    got = keywords.keyword_hits(texts, words, bound=bound).select("id", "word", "occurrences").collect()
    assert sorted(map(tuple, got)) == plain(TEXTS, WORDS)
    assert keywords.keyword_hits(texts, words.where("false"), bound=bound).count() == 0
    assert keywords.keyword_hits(texts.where("false"), words, bound=bound).count() == 0


@pytest.mark.parametrize("bound", [1000, 0])
def test_random_texts(spark, bound):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab了") for _ in range(rng.randrange(60))) for _ in range(40)]
    words = ["".join(rng.choice("ab了") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    got = keywords.keyword_hits(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(w,) for w in words], "word string"), bound=bound)
    assert sorted((r.id, r.word, r.occurrences) for r in got.collect()) == plain(texts, words)


@pytest.mark.parametrize("bound", [100, 0])
def test_tenants_have_their_own_words(spark, bound):
    texts = spark.createDataFrame([(1, "red and blue", 7), (2, "red and blue", 8), (3, "red and blue", None)], "id int, text string, t int")
    words = spark.createDataFrame([(7, "red"), (8, "blue"), (8, "red"), (None, "and")], "tenant_id long, word string")
    got = {(r.id, r.word) for r in keywords.keyword_hits(texts, words, tenant="t", bound=bound).collect()}
    assert got == {(1, "red"), (1, "and"), (2, "red"), (2, "blue"), (2, "and"), (3, "and")}


def test_features_count_within_the_row(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "A b"), (1, "A b"), (2, "z"), (3, None), (4, "BB")], "id int, text string")
    features = spark.createDataFrame([("x", ["a", "B", "b"], True), ("y", ["bb", ""], True), ("off", ["z"], False)], "feature_id string, patterns array<string>, is_active boolean")
    want = [(1, "x", 3), (1, "x", 3), (4, "x", 2), (4, "y", 1)]  # a row that occurs twice comes back twice
    assert sorted((r.id, r.feature_id, r.n_patterns) for r in keywords.match_features(texts, features).collect()) == want
    monkeypatch.setattr(keywords, "WORDS", 0)
    assert sorted((r.id, r.feature_id, r.n_patterns) for r in keywords.match_features(texts, features).collect()) == want
    assert keywords.match_features(texts, features.where(F.col("feature_id") == "off")).count() == 0
