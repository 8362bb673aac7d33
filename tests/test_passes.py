"""Texts are scored once, by native functions, however many passes a model makes over them."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from fieldtrust.functions import hashing
from fieldtrust.operators import keywords, text_rules
from fieldtrust.plans import registry
from fieldtrust.plans.tables import PROSE


def test_training_reads_scored_rows(spark, sf_dir):
    df = registry.QUERIES["model_evaluation"](spark, sf_dir)
    assert not any("documents" in f for f in df.inputFiles())


def test_few_words_are_found_natively(spark):
    df = spark.createDataFrame([("aaaa abab trash trashtrash é!",), ("",), (None,), ("bab aaa",)], "text string")
    assert "Arrow" not in text_rules.analyze(df, PROSE)._jdf.queryExecution().executedPlan().toString()
    words = ("aa", "aba", "trash", "é", "none")
    more = (*words, *[f"other{i}" for i in range(keywords.FEW)])
    got = df.select(keywords.matches(F.col("text"), words).alias("few"), keywords.matches(F.col("text"), more).alias("many")).collect()
    assert [r.few for r in got] == [r.many for r in got] and [(x.w, x.n) for x in got[0].few] == [(0, 2), (1, 1), (2, 3), (3, 1)]


def test_codes_are_counted_not_sorted(spark):
    df = spark.createDataFrame([("abca",), ("",), (None,), ("😀é" * 40,)], "text string").repartition(1).select("text", hashing.histogram(F.col("text"), 8).alias("v"))
    assert "sort" not in df._jdf.queryExecution().executedPlan().toString().lower()
    for r in df.collect():
        n = [sum(ord(c) % 8 == b for c in r.text or "") for b in range(8)]
        size = sum(x * x for x in n) ** 0.5
        assert all(abs(x - (m / size if size else 0)) < 1e-12 for x, m in zip(r.v, n, strict=True))


def test_many_hits_of_many_texts_stay_small(spark):
    words = tuple(f"{i:04d}" for i in range(2000))
    a = keywords._automaton(words)
    texts = ["".join(words), None, "", "0001 0001", "x"] * 120
    tracemalloc.start()
    found = keywords.scanned(pa.array(texts), a)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [[(x["w"], x["n"]) for x in r] for r in found.to_pylist()] == [keywords.hits(t, a) if t else [] for t in texts]
    assert peak < 12_000_000  # 240,000 hits as tuples take 30 MB
