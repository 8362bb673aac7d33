"""The likest name among candidates, by the ratio of longest matching blocks.

The ratio of two names is costly and of no use to a join, but two bounds on it are cheap: that of their lengths, and that of the characters
they share however placed, which is a matrix product for all pairs of two tiles. Distinct names lie in tiles of neighbours in the order
of group, length and name. A name first meets its own tile, where names begin alike, which gives it a good ratio to beat; then only tiles
whose lengths could beat it are met, and of a tile only names whose bound is no less than what has been found, from the best bound down.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.operators.graph import checkpoint_dir

#: Names of a tile, lengths of a band, and bins that characters are counted in.
TILE, BAND, BINS = 2048, 16, 64
#: Names whose bounds are worked out at once, and columns of one matrix product.
BLOCK, COLUMNS = 256, 1024


def counted(names: list[str]) -> np.ndarray:
    """How often each bin of characters occurs in each name."""
    codes = [np.frombuffer(n.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS for n in names]
    at = np.repeat(np.arange(len(names)), [len(c) for c in codes]) * BINS
    return np.bincount(at + np.concatenate([*codes, np.zeros(0, np.uint32)]).astype(np.int64), minlength=len(names) * BINS).reshape(-1, BINS).astype(np.int32)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many characters each name of ``a`` shares with each of ``b``, however placed: the bins in which both have one, those in which both have two, and so on."""
    most = np.minimum(a.max(axis=0, initial=0), b.max(axis=0, initial=0))
    bins = np.repeat(np.arange(BINS), most)
    times = np.concatenate([np.arange(1, m + 1) for m in most]) if len(bins) else np.zeros(0, np.int64)
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(bins), COLUMNS):
        c, t = bins[at : at + COLUMNS], times[at : at + COLUMNS]
        out += (a[:, c] >= t).astype(np.float32) @ (b[:, c] >= t).astype(np.float32).T
    return out


def best_of(names: list[str], best: np.ndarray, match: list[str | None], others: list[str], same: bool) -> np.ndarray:
    """Raise ``best`` and ``match`` of each name to its likest of ``others`` (``same``: the lists hold the same names, of which none meets itself); returns how many ratios each took.

    Of others that are equally like the one that sorts first is taken; one whose bound is what has been found can only be as like, so it is passed over where it sorts later.
    """
    a, b = counted(names), counted(others)
    la, lb = a.sum(axis=1), b.sum(axis=1)
    taken = np.zeros(len(names), np.int64)
    for lo in range(0, len(names), BLOCK):
        rows = slice(lo, lo + BLOCK)
        bounds = 2.0 * shared(a[rows], b) / (la[rows, None] + lb)
        for i, bound in enumerate(bounds, lo):
            n = names[i]
            some = np.flatnonzero(bound >= best[i])
            for j in some[np.argsort(-bound[some], kind="stable")].tolist():
                if bound[j] < best[i]:
                    break
                o = others[j]
                if (same and o == n) or (bound[j] == best[i] and match[i] is not None and o >= match[i]):
                    continue
                r = SequenceMatcher(None, n, o).ratio()
                taken[i] += 1
                if r > best[i] or (r == best[i] and (match[i] is None or o < match[i])):
                    best[i], match[i] = r, o
    return taken


def _parts(df: DataFrame) -> int:
    """A fixed number of parts: the work of tiles is that of their pairs, which their bytes do not tell."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _tiled(df: DataFrame) -> DataFrame:
    """``df(g, name, ...)`` with ``part``: names that are neighbours by group, band of lengths and name, ``TILE`` at most. No task holds a group."""
    parts = _parts(df)
    dealt = df.withColumn("band", F.floor(F.length("name") / BAND)).repartitionByRange(parts, "g", "band", "name").sortWithinPartitions("g", "band", "name")
    return dealt.withColumn("part", F.floor(F.monotonically_increasing_id() / TILE))


def best_name_match(names: DataFrame, candidates: DataFrame | None = None, key: str = "record_id", name: str = "name", group: str | None = None) -> DataFrame:
    """(key, text_similarity, match, n_ratios) of every row of ``names(key, name[, group])``: the greatest ratio to a name of ``candidates(name[, group])``, of the same group where one is given.

    Without ``candidates`` a row is held against the other rows of ``names``. Empty and null names are like nothing and no one's
    match: 0, match null; so are rows without a candidate or with a null group. Equal names have ratio 1. ``n_ratios``: ratios taken
    for all rows of the name. Of equally like names the one that sorts first is the match. A task holds two tiles at a time.
    """
    checkpoint_dir(names.sparkSession)
    g = F.lit("") if group is None else F.col(group).cast("string")
    rows = names.select(key, g.alias("g"), F.col(name).alias("name"))
    real = lambda d: d.where("g IS NOT NULL AND name <> ''")
    own = candidates is None
    if own:
        distinct = real(rows).groupBy("g", "name").agg((F.count("*") == 1).alias("asks"), F.lit(True).alias("offers"), (F.count("*") > 1).alias("equal"))
    else:
        both = real(rows).select("g", "name", F.lit(True).alias("a")).unionAll(real(candidates.select(g.alias("g"), F.col(name).alias("name"))).select("g", "name", F.lit(False)))
        distinct = both.groupBy("g", "name").agg((F.min("a") & F.max("a")).alias("asks"), (~F.min("a")).alias("offers"), (F.max("a") & ~F.min("a")).alias("equal"))
    tiled = _tiled(distinct).checkpoint()
    equal = tiled.where("equal").select("g", "name", F.lit(1.0).alias("best"), F.col("name").alias("match"), F.lit(0).cast("long").alias("n_ratios"))
    kinds = "g string, name string, best double, match string, n_ratios long"
    by = ["g", "band", "part"]

    def raised(x: pd.DataFrame, others: list[str]) -> pd.DataFrame:
        best, match = x.best.to_numpy(np.float64).copy(), [m if isinstance(m, str) else None for m in x.match]
        taken = best_of(x.name.tolist(), best, match, others, own)
        return pd.DataFrame({"g": x.g, "name": x.name, "best": best, "match": match, "n_ratios": taken})

    def within(t: pd.DataFrame) -> pd.DataFrame:
        """A tile's names that ask against those that it offers."""
        asks = t[t.asks].assign(best=0.0, match=None)
        return raised(asks, sorted(t.name[t.offers]))

    def between(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=["g", "name", "best", "match", "n_ratios"])
        return raised(x, sorted(y.r_name))

    # what a tile's lengths allow at best
    def allowed(low: Column, high: Column) -> Column:
        return F.when(F.col("o_low") > high, 2 * high / (high + F.col("o_low"))).when(F.col("o_high") < low, 2 * F.col("o_high") / (low + F.col("o_high"))).otherwise(1.0)

    parts = _parts(rows)
    asking = tiled.groupBy(*by).agg(F.max("asks").alias("_some"))
    first = tiled.join(asking.where("_some").select(*by), by).select("g", "name", "asks", "offers", *by[1:]).repartition(parts, *by).groupBy(*by).applyInPandas(within, kinds)
    state = tiled.where("asks").select("g", "name", *by[1:]).join(first, ["g", "name"]).checkpoint()
    tiles = tiled.where("offers").groupBy("g", F.col("band").alias("o_band"), F.col("part").alias("o_part")).agg(F.min(F.length("name")).alias("o_low"), F.max(F.length("name")).alias("o_high"))
    spans = state.groupBy(*by).agg(F.min(F.length("name")).alias("low"), F.max(F.length("name")).alias("high"), F.min("best").alias("least"))
    other = (F.col("o_band") != F.col("band")) | (F.col("o_part") != F.col("part"))
    pairs = spans.join(tiles, "g").where(other & (allowed(F.col("low"), F.col("high")) >= F.col("least") - 1e-12)).drop("low", "high", "least").checkpoint()
    meet = [*by, "o_band", "o_part"]
    n = F.length("name")
    a = state.join(pairs, by).where(allowed(n, n) >= F.col("best") - 1e-12).select(*meet, "name", "best", "match")
    b = tiled.where("offers").select("g", F.col("band").alias("o_band"), F.col("part").alias("o_part"), "name").join(pairs.drop("o_low", "o_high"), ["g", "o_band", "o_part"])
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in (*meet, "name")])
    a, b = a.repartition(parts, *meet), b.repartition(parts, *[f"r_{c}" for c in meet])
    found = a.groupBy(*meet).cogroup(b.groupBy(*[f"r_{c}" for c in meet])).applyInPandas(between, kinds)
    # the greatest, of equals the match that sorts first; no match is the last
    order = F.struct((F.lit(0.0) - F.col("best")).alias("less"), F.col("match").isNull().alias("none"), F.col("match").alias("match"))
    every = state.select("g", "name", "best", "match", "n_ratios").unionByName(found)
    best = every.groupBy("g", "name").agg(F.min(order).alias("top"), F.sum("n_ratios").alias("n_ratios"))
    known = best.where(~F.col("top.none")).select("g", "name", (F.lit(0.0) - F.col("top.less")).alias("best"), "top.match", "n_ratios").unionByName(equal)
    out = rows.join(known, ["g", "name"], "left")
    return out.select(key, F.coalesce("best", F.lit(0.0)).alias("text_similarity"), "match", F.coalesce("n_ratios", F.lit(0)).alias("n_ratios"))
