"""SimHash near-duplicates with pivot distance tables.

Every fingerprint has a row of Hamming distances to fixed pivots. By the triangle inequality two fingerprints differ by no less
than their distances to any pivot do, so a pair is out as soon as one coordinate differs by more than the limit; what all pivots
leave is compared bit by bit. So that a fingerprint need not meet all others, they are dealt by slices of their bits first: of
``limit + 1`` slices at least one is the same in both. Fingerprints that share a slice are bucketed by their distance to the first
pivot and only neighbouring buckets meet; a slice that very many share is cut into tiles along that distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import short_batches, written
from fieldtrust.llm.components import connected_components
from fieldtrust.llm.tiling import tile_pairs, tiled

PIVOTS = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, size=24, dtype=np.uint64)
SMALL = 12
TILE = 1024
BLOCK_ROWS = 8192


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of each word shingle of ``text`` (A-Z lowered) in turn; fewer words than ``width`` are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    pieces = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes; of none, 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the word shingles of ``text`` (A-Z lowered); no words give 0."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, fp long)``; a null text counts as empty."""

    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def coordinates(fps: np.ndarray) -> np.ndarray:
    """The pivot table: a row of distances to the pivots for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def pivot_pairs(left: np.ndarray, right: np.ndarray, limit: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in ``left``, in ``right``) of all pairs within ``limit`` bits, some at a time; both are in the order of their first coordinate."""
    a, b = coordinates(left), coordinates(right)
    first, last = np.searchsorted(b[:, 0], a[:, 0] - limit, side="left"), np.searchsorted(b[:, 0], a[:, 0] + limit, side="right")
    for lo in range(0, len(left), TILE):
        hi = min(lo + TILE, len(left))
        for at in range(int(first[lo]), int(last[hi - 1]), TILE):
            to = min(at + TILE, int(last[hi - 1]))
            i, j = np.nonzero(np.abs(a[lo:hi, None, 0] - b[None, at:to, 0]) <= limit)
            i, j = i + lo, j + at
            for p in range(1, len(PIVOTS), 6):
                keep = (np.abs(a[i, p : p + 6] - b[j, p : p + 6]) <= limit).all(axis=1)
                i, j = i[keep], j[keep]
            near = np.bitwise_count(left[i] ^ right[j]) <= limit
            yield i[near], j[near]


def by_first_coordinate(fps: np.ndarray) -> np.ndarray:
    return fps[np.argsort(np.bitwise_count(fps ^ PIVOTS[0]), kind="stable")]


class _Forest:
    """Keeps those of the pairs added that connect what was apart."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.a: list[int] = []
        self.b: list[int] = []

    def top(self, x: int) -> int:
        while (y := self.root.setdefault(x, x)) != x:
            self.root[x] = x = self.root.setdefault(y, y)
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.a.append(x)
                self.b.append(y)


def pivot_links(block: np.ndarray, limit: int = 2) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``block`` (distinct uint64) within ``limit`` bits."""
    block, forest = by_first_coordinate(block), _Forest()
    for i, j in pivot_pairs(block, block, limit):
        keep = i < j
        forest.add(block[i[keep]], block[j[keep]])
    return list(zip(forest.a, forest.b, strict=True))


def _small_links(blocks: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``limit`` in many blocks of the same few members at once: ``blocks`` is (blocks, members)."""
    table = np.bitwise_count(blocks[:, :, None] ^ PIVOTS[None, None, :8]).astype(np.int8)
    a, b = [], []
    for i, j in combinations(range(blocks.shape[1]), 2):
        rows = np.flatnonzero(np.abs(table[:, i] - table[:, j]).max(axis=1) <= limit)
        rows = rows[np.bitwise_count(blocks[rows, i] ^ blocks[rows, j]) <= limit]
        a.append(blocks[rows, i])
        b.append(blocks[rows, j])
    return np.concatenate(a), np.concatenate(b)


def slices(fp: Column, limit: int) -> Column:
    """Structs (slice number, its bits) of ``limit + 1`` slices that cover the 64 bits."""
    edges = [64 * i // (limit + 1) for i in range(limit + 2)]
    cut = lambda a, b: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) if b - a < 64 else fp
    return F.array(*[F.struct(F.lit(k).alias("block"), cut(a, b).alias("key")) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def links(distinct: DataFrame, limit: int = 2, most: int = BLOCK_ROWS) -> DataFrame:
    """``distinct(fp)`` to edges ``(a, b)`` that connect all fingerprints within ``limit`` bits.

    A slice that up to ``most`` fingerprints share is one row and one small task's work; beyond that it is cut into tiles of ``most``.
    """
    keyed = distinct.select("fp", F.explode(slices(F.col("fp"), limit)).alias("s")).select("fp", "s.block", "s.key")
    counts = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    counts = written(counts, "simhash-slices")
    shared = keyed.join(counts, ["block", "key"])
    blocks = shared.where(F.col("n") <= most).groupBy("block", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            flat = np.asarray(col.flatten()).astype(np.int64).view(np.uint64)
            offsets = np.asarray(col.offsets)
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            left, right = [], []
            for n in np.unique(sizes):
                at = offsets[:-1][sizes == n]
                if n <= SMALL:
                    a, b = _small_links(flat[at[:, None] + np.arange(n)[None, :]], limit)
                    left.append(a)
                    right.append(b)
                else:
                    for k in at:
                        if pairs := pivot_links(flat[k : k + n], limit):
                            x = np.array(pairs, dtype=np.uint64)
                            left.append(x[:, 0])
                            right.append(x[:, 1])
            a = np.concatenate(left) if left else np.empty(0, np.uint64)
            b = np.concatenate(right) if right else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    found = blocks.mapInArrow(run, "a long, b long")
    if not counts.where(F.col("n") > most).limit(1).count():
        return found
    first = int(PIVOTS[0])
    first = first - (1 << 64) if first >> 63 else first
    large = shared.where(F.col("n") > most).withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.lit(first))).cast("long"))
    large = written(tiled(large.select("fp", "block", "key", "d"), ["block", "key"], "d", F.col("fp"), most), "simhash-tiles")
    pairs = written(tile_pairs(large, ["block", "key"], "d", limit), "simhash-tile-pairs")
    here = large.withColumnRenamed("tile", "ta").join(pairs, ["block", "key", "ta"]).select("block", "key", "ta", "tb", "fp")
    there = large.withColumnRenamed("tile", "tb").join(pairs, ["block", "key", "tb"]).where("ta <> tb").select("block", "key", "ta", "tb", "fp").toDF("yblock", "ykey", "yta", "ytb", "yfp")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p, forest = by_first_coordinate(x.fp.to_numpy(np.int64).view(np.uint64)), _Forest()
        q = by_first_coordinate(y.yfp.to_numpy(np.int64).view(np.uint64)) if len(y) else p
        for i, j in pivot_pairs(p, q, limit) if len(p) else ():
            keep = p[i] < q[j] if not len(y) else slice(None)
            forest.add(p[i][keep], q[j][keep])
        return pd.DataFrame({"a": np.array(forest.a, np.uint64).view(np.int64), "b": np.array(forest.b, np.uint64).view(np.int64)})

    key = ["block", "key", "ta", "tb"]
    return found.unionAll(here.groupBy(*key).cogroup(there.groupBy(*[f"y{k}" for k in key])).applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, limit: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fingerprint, component_id, part)``, one row for each input row; ``part`` is the group's
    least fingerprint in signed order.

    Copies share a fingerprint, so a group of copies of any size is one fingerprint when links are sought. Rows with a
    null id keep their component but never name it; a component of null ids alone has a null id. Empty and null texts
    have fingerprint zero and link like any other.
    """
    fps = written(fingerprints(docs), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    parts = connected_components(links(distinct.select("fp"), limit))
    named = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "part").select("fp", "component_id", "part")
    return fps.join(named, "fp").select("doc_id", _hex("fp"), "component_id", _hex("part"))


def _hex(name: str):
    return F.lower(F.lpad(F.hex(name), 16, "0")).alias("fingerprint" if name == "fp" else name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("part")
