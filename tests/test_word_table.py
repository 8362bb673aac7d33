"""Words held as arrays against plain counts, and how much memory they take."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldtrust.operators import keywords


def test_counts_are_plain_counts(monkeypatch):
    rng = random.Random(7)
    make = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    for step, of in ((1 << 18, "ab"), (7, "ab了"), (64, "aab😀"), (50, "a")):
        monkeypatch.setattr(keywords, "STEP", step)
        texts = [make(rng.randrange(90), of) for _ in range(60)] + ["", None, "a" * 300]
        words = tuple(sorted({make(rng.choice([1, 2, 3, 8, 16, 17, 18, 40]), of) for _ in range(80)} | {t[3:30] for t in texts if t and len(t) > 3}))
        found = keywords.scanned(pa.array(texts), keywords.Words(words)).to_pylist()
        assert [[(x["w"], x["n"]) for x in r] for r in found] == [[(i, t.count(w)) for i, w in enumerate(words) if w in t] if t else [] for t in texts]
    assert keywords.scanned(pa.array([], pa.string()), keywords.Words(("a",))).to_pylist() == []


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(keywords, "_BASE", np.uint64(1))  # a window's hash is the sum of its characters
    table = keywords.Words(("abc", "bca", "cab", "xyz"))
    assert keywords.hits("abcabc", table) == [(0, 2), (1, 1), (2, 1)]


def test_a_table_of_many_words_is_small():
    words = tuple(f"{i * 7919:08x}" for i in range(100_000))
    tracemalloc.start()
    table = keywords.Words(words)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 80 * len(words) and keywords.hits("00001eef 00003dde", table) == [(1, 1), (2, 1)]


def test_tables_beyond_the_old_bound_shuffle_no_substrings(spark):
    words = spark.range(250_000).select(F.lpad(F.hex("id"), 8, "0").alias("word"))
    texts = spark.createDataFrame([(1, "0000000A 0003D08F 0003D090")], "id int, text string")
    out = keywords.keyword_hits(texts, words)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert sorted(r.word for r in out.collect()) == ["0000000A", "0003D08F"]
