"""Benchmark decontamination by spaced-seed hashing.

A mask fixes which tokens of a window count; the others are ignored, so a window still matches where a token that the mask
skips was changed. Hashes of all windows of the texts meet those of the benchmark; around each hit the two are laid on each
other and a stretch of tokens must agree up to a share of substitutions. Items shorter than that stretch have masks of their
length. Every set of masks here leaves out, by one mask at least, any places that may differ: no overlap is missed.
DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import written

#: Of the 13 places of a stretch any two may differ: one of these, laid somewhere on the stretch, ignores both.
MASKS = ("1010111001", "1100010111")
WINDOW = 13
AGREE = 0.8
#: Places that a mask of a short item keeps at least, where the item has as many beside those that may differ.
KEEP = 5
#: Items of fewer tokens than this are common phrases; only a text that consists of one is a leak of it.
PHRASE = 5
#: Seed rows of the benchmark up to which its table is broadcast (about 32 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def short_masks(n: int, misses: int) -> list[str]:
    """Masks of ``n`` places of which one ignores any given ``misses`` places.

    The places are dealt to groups, and each mask ignores ``misses`` whole groups; the fewest groups that leave ``KEEP`` places.
    """
    for groups in range(misses + 1, n + 1):
        ignored = [set(c) for c in combinations(range(groups), misses)]
        masks = ["".join("0" if i % groups in c else "1" for i in range(n)) for c in ignored]
        if min(m.count("1") for m in masks) >= min(KEEP, n - misses):
            return masks
    raise ValueError(f"{misses} of {n} places cannot be ignored")


def _seeds(df: DataFrame, toks: Column, keep: list[str], masks: dict[str, int], starts: list[tuple[str, int | None]]) -> DataFrame:
    """Rows (keep..., at, seed): hashes of windows under the named masks, at one given place or (None) at every place.

    ``masks`` numbers the masks, so that windows under different masks do not meet.
    """
    h = F.col("_h")

    def of(mask: str, start: int | None) -> Column:
        at = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size(h) - len(mask)
        places = F.array(F.lit(start)) if start is not None else F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(masks[mask]), *[F.get(h, i + a) for a in at]).alias("seed")))

    df = df.select(*keep, F.transform(toks, lambda t: F.xxhash64(t)).alias("_h"))
    return df.select(*keep, F.explode(F.concat(*[of(m, start) for m, start in starts])).alias("_w")).select(*keep, "_w.at", "_w.seed")


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that name a text; verdicts hang on the text alone, so copies share them."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")]


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """Verified overlaps ``(k1, k2, item_id, matched, item_tokens)`` of distinct texts with benchmark items.

    A text overlaps an item where some ``min(window, item's tokens)`` tokens in a row, laid on the item at a seed hit,
    agree in at least the share ``agree``; ``matched`` counts the tokens that agree over the whole item at its best place.
    Items of fewer tokens than ``window`` are sought under ``short_masks``; one under ``PHRASE`` tokens must be the whole text,
    token for token; an item without tokens matches nothing. Items that repeat an id or a text each count once. Null texts are empty.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item") > 0).dropDuplicates(["item_id", "item"])
    items = written(items.withColumn("item_no", F.xxhash64("item_id", "item")), "benchmark-items")
    size = F.size("item")
    # (items, the windows sought in them): a mask of a short item lies on the item at one place, without the zeros at its ends
    sought = [(size >= window, [(m, None) for m in masks])]
    for n in sorted(r[0] for r in items.select(size).where((size >= PHRASE) & (size < window)).distinct().collect()):  # fewer lengths than a window has places
        sought.append((size == n, [(m.strip("0"), m.index("1")) for m in short_masks(n, n - math.ceil(n * agree))]))
    number = {m: k for k, m in enumerate(dict.fromkeys(m for _, starts in sought for m, _ in starts))}
    parts = [_seeds(items.where(which), F.col("item"), ["item_no"], number, starts) for which, starts in sought]
    seeds = written(reduce(DataFrame.unionAll, parts).withColumnRenamed("at", "item_at").distinct(), "benchmark-seeds")
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    texts = docs.select(*text_key(F.col("text")), "text")
    of_texts = _seeds(texts, tokens(F.col("text")), ["k1", "k2"], number, [(m, None) for m in number])
    hits = of_texts.join(seeds, "seed").select("k1", "k2", "item_no", (F.col("at") - F.col("item_at")).alias("shift"))
    phrases = items.where(size < PHRASE).select(F.xxhash64("item").alias("seed"), "item_no")
    whole = texts.select("k1", "k2", F.xxhash64(tokens(F.col("text"))).alias("seed")).join(phrases, "seed")
    hits = hits.unionAll(whole.select("k1", "k2", "item_no", F.lit(0).alias("shift")))
    hits = written(hits.distinct(), "benchmark-hits")  # its size on disk decides how it is joined
    there = texts.join(hits.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("k1", "k2", tokens(F.col("text")).alias("toks"))
    both = there.join(hits, ["k1", "k2"]).join(items, "item_no")
    n = F.size("item")
    same = F.transform("item", lambda t, i: (F.coalesce(F.get(F.col("toks"), i + F.col("shift")), F.lit("")) == t).cast("int"))
    run = F.least(n, F.lit(window))
    need = F.when(n < PHRASE, n).otherwise(F.ceil(run * F.lit(agree)))
    held = F.exists(F.sequence(F.lit(1), n - run + 1), lambda s: F.aggregate(F.slice("same", s, run), F.lit(0), lambda a, x: a + x) >= need)
    found = both.where((n >= PHRASE) | (n == F.size("toks"))).select("k1", "k2", "item_id", "item", "toks", same.alias("same")).where(held)
    matched = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    return found.groupBy("k1", "k2", "item_id").agg(F.max(matched).alias("matched"), F.max(F.size("item")).alias("item_tokens"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item; all columns stay as they are."""
    bad = written(overlaps(docs, benchmark).select("k1", "k2").distinct(), "benchmark-bad")
    k1, k2 = text_key(F.col("text"))
    # the row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct("*").alias("row"), k1, k2)
    return rows.join(bad, ["k1", "k2"], "left_anti").select("row.*")


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, contaminated, n_items, item_ids, best_matched)``, one row for each input row."""
    found = overlaps(docs, benchmark).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("matched").cast("long").alias("best_matched"))
    found = written(found, "benchmark-found")
    return (
        docs.select("doc_id", *text_key(F.col("text")))
        .join(found, ["k1", "k2"], "left")
        .select(
            "doc_id",
            F.col("item_ids").isNotNull().alias("contaminated"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce(F.array_join("item_ids", ","), F.lit("")).alias("item_ids"),
            F.coalesce("best_matched", F.lit(0)).alias("best_matched"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return flagged(read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text"))


#: No seeds: equal tokens of texts and items, counted by diagonal; short phrases as whole texts.
ORACLE_SQL = f"""
WITH d AS (SELECT text, t, row_number() OVER () AS dn FROM (SELECT DISTINCT text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents)),
b AS (SELECT item_id, t, len(t) AS n, row_number() OVER () AS bn FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM benchmark)),
dt AS (SELECT dn, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM d),
bt AS (SELECT bn, n, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM b WHERE n >= {PHRASE}),
e AS (SELECT dn, bn, n, dt.i - bt.i AS shift, bt.i FROM dt JOIN bt USING (tok)),
g AS (SELECT *, count(*) OVER (PARTITION BY dn, bn, shift) AS matched FROM e QUALIFY matched >= ceil(least(n, {WINDOW}) * {AGREE})),
w AS (SELECT *, count(*) OVER (PARTITION BY dn, bn, shift ORDER BY i RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS run FROM g),
v AS (SELECT dn, bn, matched FROM w WHERE run >= ceil(least(n, {WINDOW}) * {AGREE})
  UNION ALL SELECT d.dn, b.bn, b.n FROM d JOIN b ON d.t = b.t WHERE b.n BETWEEN 1 AND {PHRASE - 1}),
i AS (SELECT dn, item_id, max(matched) AS matched FROM v JOIN b USING (bn) GROUP BY dn, item_id),
f AS (SELECT text, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(matched) AS best_matched FROM i JOIN d USING (dn) GROUP BY text)
SELECT x.doc_id, f.text IS NOT NULL AS contaminated, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, coalesce(f.item_ids, '') AS item_ids, CAST(coalesce(f.best_matched, 0) AS BIGINT) AS best_matched
FROM documents x LEFT JOIN f ON f.text = x.text
"""
