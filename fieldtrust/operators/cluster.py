"""Clusters of like vectors: links at a cosine, components, and the earlier rows a row is like.

Pairs are found block against block with a matrix product. Vectors are blocked by their nearest pivot and the angle to it.
Angles obey the triangle inequality: blocks whose angles to some pivot are further apart than the threshold allows hold no link
and never meet. No task holds more than two blocks. Each vector is sent to the blocks that it meets: blocks grow with the rows
up to ``WIDEST`` times ``BLOCK_ROWS``, so that their number, and with it what a vector is sent to, stays about the same until then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldtrust.operators import slices
from fieldtrust.operators.graph import checkpoint_dir, components
from fieldtrust.params import DEFAULT, Params

BLOCK_ROWS = 2048
#: About so many blocks (and as many as pivots), and how far their rows may grow for it.
BLOCKS, WIDEST = 64, 16
#: Cosines that a task holds at once.
COSINES = 1 << 22
PIVOTS = 32
BIN = 0.02  # radians; block bounds are looked up by bins of this width
SLACK = 1e-6  # of angles, for rounding
TOP = 10


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled by their largest component first so that no square overflows; rows without a length or with a component that is no number become NaN."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        m = m / np.abs(m).max(axis=1, keepdims=True, initial=0)
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(lists, d: int) -> np.ndarray:
    return np.array([[math.nan if x is None else x for x in v] for v in lists], np.float64).reshape(len(lists), d)


def blocked(df: DataFrame, key: str, vector: str, rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """``(block, d, cell, angles, id, v)``: vectors of ``d`` components as they came (floats stay floats), their nearest pivot and the angles to all, in blocks of about ``rows`` or, of very many vectors, up to ``WIDEST`` times that.

    Pivots are at most ``pivots`` vectors, drawn by a hash of their key; a vector whose length none of them has lies in cell -1.
    Vectors that are null, have no length or hold a component that is null or not finite are left out: they are like nothing.
    """
    checkpoint_dir(df.sparkSession)
    kind = "array<float>" if isinstance(df.schema[vector].dataType, T.ArrayType) and isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "array<double>"
    v = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    drawn: dict[int, list[list[float]]] = {}
    for r in v.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).collect():  # so many rows
        drawn.setdefault(len(r.v), []).append(r.v)
    at: dict[int, np.ndarray] = {}
    for d, some in drawn.items():
        m = _unit(_matrix(some, d))
        m = m[np.isfinite(m).all(axis=1)]
        if len(m):
            at[d] = m

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch.v.map(len)):
                m = _unit(_matrix(part.v, d))
                good = np.isfinite(m).all(axis=1) & (d > 0)
                if not good.any():
                    continue
                m, ids, own = m[good], part.id.to_numpy()[good], part.v[good]
                angles = np.arccos(np.clip(m @ at[d].T, -1, 1)) if d in at else np.zeros((len(m), 1))
                cell = angles.argmin(axis=1) if d in at else np.full(len(m), -1)
                yield pd.DataFrame({"d": d, "cell": cell, "bin": (angles.min(axis=1) / BIN).astype(int), "angles": list(angles), "id": ids, "v": own.to_numpy()})

    v = v.mapInPandas(place, f"d int, cell int, bin int, angles array<double>, id long, v {kind}").checkpoint()
    rows = max(rows, min(v.count() // BLOCKS, WIDEST * rows))
    before = F.sum("n").over(Window.partitionBy("d", "cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    counts = v.groupBy("d", "cell", "bin").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    # bins follow each other in blocks; one that is larger than a block by itself is dealt to several
    wide = F.col("n") > rows
    name = F.concat_ws(":", "d", "cell", F.floor(F.col("before") / rows), F.when(wide, F.concat_ws("/", "bin", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / rows)))))
    return v.join(counts, ["d", "cell", "bin"]).select(name.alias("block"), "d", "cell", "angles", "id", "v").checkpoint()


def meeting_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """``(i, j)``, i <= j: the blocks that can hold vectors at a cosine of ``threshold`` or more."""
    reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    spans = blocks.select("block", "d", "cell", F.posexplode("angles").alias("q", "angle")).groupBy("block", "d", "cell", "q").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    every = spans.groupBy("block", "d", "cell").agg(F.array_sort(F.collect_list(F.struct("q", "lo", "hi"))).alias("s")).checkpoint()  # as many as pivots
    own = F.get("s", F.greatest("cell", F.lit(0)))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BIN), F.floor(hi / BIN)))
    # a block asks at its own pivot, for the angles within reach of its own
    asks = every.select(F.col("block").alias("i"), "d", F.greatest("cell", F.lit(0)).alias("q"), F.col("s").alias("x"), bins(own["lo"] - reach, own["hi"] + reach).alias("bin"))
    has = every.select(F.col("block").alias("j"), "d", F.col("s").alias("y"), F.explode("s").alias("o")).select("j", "d", "y", F.col("o.q").alias("q"), bins(F.col("o.lo"), F.col("o.hi")).alias("bin"))
    both = asks.join(has, ["d", "q", "bin"]).where(F.col("i") <= F.col("j"))
    near = F.forall(F.zip_with("x", "y", lambda x, y: (x["lo"] - y["hi"] <= reach) & (y["lo"] - x["hi"] <= reach)), lambda ok: ok)
    return both.where(near).select("i", "j").distinct()


def _block_pairs(df: DataFrame, key: str, vector: str, threshold: float, found, kinds: str) -> DataFrame:
    """What ``found(ids, other ids, cosines, own)`` returns for each pair of blocks that can meet; ``own`` says that a block meets itself. Vectors of other lengths never meet."""
    v = blocked(df, key, vector)
    meet = meeting_blocks(v, threshold).checkpoint()
    left = v.select(F.col("block").alias("i"), "id", "v").join(meet, "i")
    right = v.select(F.col("block").alias("rj"), F.col("id").alias("rid"), F.col("v").alias("rv")).join(meet.where("i <> j").toDF("ri", "rj"), "rj")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in kinds.split(", ")]
        own = len(x) > 0 and x.i.iloc[0] == x.j.iloc[0]
        if not len(x) or not (own or len(y)):
            return pd.DataFrame(columns=columns)
        a = _unit(np.vstack(x.v.to_numpy()).astype(np.float64))
        b, other = (a, x.id) if own else (_unit(np.vstack(y.rv.to_numpy()).astype(np.float64)), y.rid)
        ids, other, step = x.id.to_numpy(), other.to_numpy(), max(1, COSINES // len(b))
        strips = [pd.DataFrame(found(ids[at : at + step], other, a[at : at + step] @ b.T, own), columns=columns) for at in range(0, len(a), step)]
        return pd.concat(strips, ignore_index=True)

    return left.groupBy("i", "j").cogroup(right.groupBy("ri", "rj")).applyInPandas(compare, kinds)


def _ordered(ids: np.ndarray, other: np.ndarray, c: np.ndarray, own: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.nonzero(c >= threshold)
    a, b = ids[i], other[j]
    keep = a < b if own else a != b
    return np.minimum(a, b)[keep], np.maximum(a, b)[keep], c[i, j][keep]


def similar_pairs(df: DataFrame, threshold: float = DEFAULT.cosine, key: str = "seq", vector: str = "vector") -> DataFrame:
    """``df(key, vector)`` to pairs ``(a, b, cosine)``, a < b, at or over the threshold; vectors without length link with nothing."""

    def found(ids, other, c, own):
        a, b, c = _ordered(ids, other, c, own, threshold)
        return {"a": a, "b": b, "cosine": c}

    return _block_pairs(df, key, vector, threshold, found, "a long, b long, cosine double")


def links(df: DataFrame, threshold: float = DEFAULT.cosine, key: str = "seq", vector: str = "vector") -> DataFrame:
    """Links ``(a, b)`` that join what the pairs at or over the threshold join: of the rows that meet in a task each to the least one it reaches, as many rows as vectors, not as pairs."""

    def found(ids, other, c, own):
        a, b, _ = _ordered(ids, other, c, own, threshold)
        linked, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = slices.roots(len(linked), [(at[: len(a)], at[len(a) :], None)])
        moved = np.flatnonzero(root != np.arange(len(linked)))
        return {"a": linked[root[moved]], "b": linked[moved]}

    return _block_pairs(df, key, vector, threshold, found, "a long, b long")


def batch_clusters(df: DataFrame, p: Params = DEFAULT, key: str = "seq", vector: str = "vector") -> DataFrame:
    """Density clusters of a batch with two points to a core: components of the links at the cosine threshold.

    Adds ``cluster_id`` (the least key; -1 alone), ``cluster_size`` (alone: the number of all that are alone),
    ``is_cluster_anomaly`` (a cluster of more than five) and ``semantic_score``.
    """
    parts = components(links(df, p.cosine, key, vector))
    labelled = df.join(parts, df[key] == parts.node, "left").drop("node").withColumn("cluster_id", F.coalesce("component", F.lit(-1).cast("long"))).drop("component")
    sizes = parts.groupBy(F.col("component").alias("cluster_id")).agg(F.count("*").alias("n"))
    # all that are alone share one size: a row by itself, not a key of the join
    alone = F.broadcast(labelled.agg(F.count_if(F.col("cluster_id") == -1).alias("n_alone")))
    out = labelled.join(sizes, "cluster_id", "left").join(alone).withColumn("cluster_size", F.coalesce("n", "n_alone")).drop("n", "n_alone")
    odd = (F.col("cluster_id") != -1) & (F.col("cluster_size") > p.cluster_size)
    return out.withColumns({"is_cluster_anomaly": odd, "semantic_score": F.when(odd, F.least(F.col("cluster_size") / 20.0, F.lit(1.0)) * 100).otherwise(0.0)})


def prior_clusters(df: DataFrame, p: Params = DEFAULT, key: str = "seq", vector: str = "vector") -> DataFrame:
    """Each row against the rows before it; the first row of all is never stored, so nothing is like it.

    Adds ``cluster_size`` (like rows and itself), ``similar_ids`` (the ten likest, then by order), ``semantic_score``. A pair of
    blocks gives a row's count and its ten likest, not all that are like it.
    """
    first = df.agg(F.min(key)).first()[0]

    def found(ids, other, c, own):
        a, b, c = _ordered(ids, other, c, own, p.cosine)
        keep = a != first
        order = np.lexsort((a[keep], -c[keep], b[keep]))
        a, b, c = a[keep][order], b[keep][order], c[keep][order]
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.empty(0, np.int64)
        counts = np.diff(np.append(starts, len(b)))
        rank = np.arange(len(b)) - np.repeat(starts, counts)
        top = rank < TOP
        return {"b": b[top], "n": np.where(rank == 0, np.repeat(counts, counts), 0)[top], "a": a[top], "cosine": c[top]}

    near = _block_pairs(df, key, vector, p.cosine, found, "b long, n long, a long, cosine double")
    # at most ten of a row from each pair of blocks
    likest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("a")))), 1, TOP)
    found_rows = near.groupBy("b").agg(F.sum("n").alias("n"), likest["a"].alias("similar_ids"))
    out = df.join(found_rows, df[key] == found_rows.b, "left").drop("b")
    size = F.coalesce("n", F.lit(0)) + 1
    score = F.when(size > p.cluster_size, F.least(size / 20.0, F.lit(1.0)) * 100).otherwise(0.0)
    return out.withColumns({"cluster_size": size, "semantic_score": score, "similar_ids": F.coalesce("similar_ids", F.array().cast("array<long>"))}).drop("n")


def leaders(df: DataFrame, threshold: float = DEFAULT.cosine, key: str = "seq", vector: str = "vector", rounds: int = 60) -> DataFrame:
    """Leader clustering in the order of ``key``: ``(key, leader)``. A row that is like no earlier leader leads; others follow the first leader they are like.

    A row can be told once all earlier rows like it are; each round tells all that can be, and is checkpointed. The rounds
    needed are the longest chain of rows that wait for each other.
    """
    checkpoint_dir(df.sparkSession)
    pairs = similar_pairs(df, threshold, key, vector).select("a", "b").checkpoint()
    state = df.select(F.col(key).cast("long").alias("id")).distinct().withColumn("leads", F.lit(None).cast("boolean")).checkpoint()
    for _ in range(rounds):
        before = pairs.join(state.select(F.col("id").alias("a"), F.col("leads").alias("led")), "a")
        seen = before.groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("led", F.lit(False))).alias("follows"), F.count_if(F.col("led").isNull()).alias("open"))
        told = F.when(F.coalesce("follows", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = state.join(seen, "id", "left").select("id", F.coalesce("leads", told).alias("leads")).checkpoint()
        if not state.where("leads IS NULL").limit(1).count():
            led = pairs.join(state.where("leads").select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("first"))
            return state.join(led, state.id == led.b, "left").select(F.col("id").alias(key), F.when(F.col("leads"), F.col("id")).otherwise(F.col("first")).alias("leader"))
    raise RuntimeError("leaders were not settled")
