"""Exports that are read back as they were, and histograms of code points against a plain count."""

import math

from pyspark.sql import functions as F

from fieldtrust.functions import hashing
from fieldtrust.sources import readers, writers


def test_csv_keeps_quotes_commas_and_line_ends(spark, tmp_path):
    rows = [(1, 'a "b", c'), (2, "two\nlines"), (3, '"'), (4, "back\\slash"), (5, "plain")]
    path = f"{tmp_path}/x.csv"
    writers.export(spark.createDataFrame(rows, "id long, text string"), path, "csv")
    assert sorted((int(r.id), r.text) for r in readers.read_any(spark, path).collect()) == rows


def test_histogram_counts_code_points(spark):
    texts = ["", None, "aab", "é😀é é", "x" * 3000]
    for bins in (64, 256):
        got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", hashing.histogram(F.col("t"), bins).alias("h")).collect()
        for r in got:
            want = [0.0] * bins
            for c in texts[r.i] or "":
                want[ord(c) % bins] += 1
            norm = math.sqrt(sum(x * x for x in want))
            assert len(r.h) == bins and all(abs(a - (b / norm if norm else 0.0)) < 1e-12 for a, b in zip(r.h, want, strict=True))
