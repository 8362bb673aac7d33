"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of a label are turned onto the principal axes of all vectors and cut into tiles by their angle to the first axis.
Tiles whose angles are too far apart never meet. Where two meet, products are accumulated over the leading axes first; the
rest of a product is bounded by the product of the two suffix norms, and comparing stops once no pair can reach the limit.
Pairs that are left are judged by their exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrust.llm.common import written
from fieldtrust.llm.components import connected_components
from fieldtrust.llm.tiling import tile_pairs, tiled

THRESHOLD = 0.93
TILE = 1024
BLOCK = 512
BINS = 20_000
SLACK = 1e-9
STOPS = (4, 8, 16, 32)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length the principal axes (columns) of the unit vectors' second moments, largest first; sums come back as d * d rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            by_size: dict[int, list] = {}
            for v in b.column(0).to_pylist():
                by_size.setdefault(len(v), []).append(v)
            for d, vs in by_size.items():
                x = np.array(vs, np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            i, j = np.indices((d, d))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], ["d", "i", "j", "s"])

    rows = vectors.select("embedding").mapInArrow(moments, "d long, i long, j long, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for d, g in rows.groupby("d"):
        m = np.zeros((d, d))
        m[g.i, g.j] = g.s
        out[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def _turned(raw: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors on the axes, and their suffix norms at the stops."""
    x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    y = x @ basis
    tail = np.sqrt(np.maximum(0.0, np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]))
    return y, np.concatenate([tail, np.zeros((len(y), 1))], axis=1)


def tile_links(left: np.ndarray, right: np.ndarray, basis: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``left`` and ``right`` whose cosine reaches ``threshold``."""
    d = left.shape[1]
    a, ta = _turned(left, basis)
    b, tb = _turned(right, basis)
    out_i, out_j = [], []
    na, nb = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    for lo in range(0, len(a), BLOCK):
        for at in range(0, len(b), BLOCK):
            x, y, sx, sy = a[lo : lo + BLOCK], b[at : at + BLOCK], ta[lo : lo + BLOCK], tb[at : at + BLOCK]
            stops = [k for k in STOPS if k < d]
            done = stops[0] if stops else d
            part = x[:, :done] @ y[:, :done].T
            i, j = np.nonzero(part + np.outer(sx[:, done], sy[:, done]) >= threshold - SLACK)
            part = part[i, j]
            for k in [*stops[1:], d]:
                if not len(i):
                    break
                if len(i) * 8 > x.shape[0] * y.shape[0]:  # many are left: a product of the tiles is cheaper than of pairs
                    part = part + (x[:, done:k] @ y[:, done:k].T)[i, j]
                else:
                    part = part + np.einsum("ij,ij->i", x[i, done:k], y[j, done:k])
                done = k
                keep = part + sx[i, k] * sy[j, k] >= threshold - SLACK
                i, j, part = i[keep], j[keep], part[keep]
            i, j = i + lo, j + at
            exact = np.einsum("ij,ij->i", left[i], right[j]) / (na[i] * nb[j])
            keep = exact >= threshold
            out_i.append(i[keep])
            out_j.append(j[keep])
    return np.concatenate(out_i), np.concatenate(out_j)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to ``(vec_id, n_links, component_id, kept)``, one row for each input row.

    Only vectors of equal, non-null label and equal length are compared. Null and zero vectors and those with null or
    non-finite components, null labels or null ids link with nothing. Equal vectors are compared once: the smallest id
    stands for all. Of a tile pair only link counts and a spanning forest leave the task, so a group of near copies costs
    rows in proportion to its size. Rows that repeat an id count as vectors of their own, and a component bears the least id of its
    rows. A bin of the angle with more than ``tile`` vectors is dealt to several tiles, so a task holds two tiles at most.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & (norm > 0) & (norm < float("inf")), F.lit(False))
    v = written(v.withColumn("ok", ok), "vectors")
    groups = v.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # an id may have several vectors, so each distinct vector gets a number of its own, which stands once written
    groups = written(groups.withColumn("rep", F.monotonically_increasing_id()), "vector-groups")
    basis = axes(groups)
    lead = {d: m[:, 0] for d, m in basis.items()}

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            theta, packed = [], []
            for e in b.column(b.schema.get_field_index("embedding")).to_pylist():
                x = np.asarray(e, np.float64)
                theta.append(float(np.arccos(np.clip(x @ lead[len(x)] / np.linalg.norm(x), -1, 1))))
                packed.append(x.tobytes())
            label, rep, copies = (b.column(b.schema.get_field_index(c)) for c in ("label", "rep", "copies"))
            sizes = [len(x) // 8 for x in packed]
            yield pa.RecordBatch.from_arrays([label, pa.array(sizes, pa.int32()), rep, copies, pa.array(packed, pa.binary()), pa.array(theta, pa.float64())], ["label", "d", "rep", "copies", "vector", "theta"])

    kinds = (("label", groups.schema["label"].dataType), ("d", T.IntegerType()), ("rep", T.LongType()), ("copies", T.LongType()), ("vector", T.BinaryType()), ("theta", T.DoubleType()))
    g = written(groups.mapInArrow(angles, T.StructType([T.StructField(*k) for k in kinds])), "vector-angles")
    binned = g.withColumn("bin", F.floor(F.col("theta") / F.lit(np.pi) * BINS))  # at most BINS counts a label
    g = written(tiled(binned, ["label", "d"], "bin", F.col("rep"), tile).drop("bin"), "vector-tiled")
    reach = float(np.arccos(min(1.0, max(-1.0, threshold)))) + 1e-6
    pairs = written(tile_pairs(g, ["label", "d"], "theta", reach), "vector-tile-pairs")
    side = ["label", "d", "ta", "tb", "rep", "copies", "vector"]
    left = g.withColumnRenamed("tile", "ta").join(pairs, ["label", "d", "ta"]).select(*side)
    right = g.withColumnRenamed("tile", "tb").join(pairs, ["label", "d", "tb"]).where("ta <> tb").select(*[F.col(c).alias(f"r_{c}") for c in side])

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        # ordered by id: the result doesn't hang on the order in which rows arrive
        x = x.sort_values("rep", kind="stable")
        own, y = not len(y), y.set_axis(side, axis=1)
        y = x if own else y.sort_values("rep", kind="stable")
        if not len(x):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        p, q = (np.frombuffer(b"".join(f["vector"]), np.float64).reshape(len(f), -1) for f in (x, y))
        i, j = tile_links(p, q, basis[p.shape[1]], threshold)
        if own:
            i, j = i[i < j], j[i < j]
        ids, other, c, o = x.rep.to_numpy(), y.rep.to_numpy(), x["copies"].to_numpy(), y["copies"].to_numpy()
        n = np.concatenate([np.bincount(i, weights=o[j], minlength=len(x)), np.bincount(j, weights=c[i], minlength=len(y))]).astype(np.int64)
        who = np.concatenate([ids, other])
        tree = _forest(ids[i], other[j])
        rows = pd.DataFrame({"a": who[n > 0], "b": who[n > 0], "n": n[n > 0]})
        return pd.concat([rows, pd.DataFrame({"a": [t[0] for t in tree], "b": [t[1] for t in tree], "n": 0})]).astype("int64")

    key = ["label", "d", "ta", "tb"]
    found = written(left.groupBy(*key).cogroup(right.groupBy(*[f"r_{c}" for c in key])).applyInPandas(compare, "a long, b long, n long"), "vector-links")
    parts = connected_components(found.where("a <> b").select("a", "b"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    known = groups.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    known = known.join(known.groupBy("part").agg(F.min("least").alias("component_id")), "part")
    known = known.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = v.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = v.where("ok").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id").unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
