"""Product codes of vectors, codebooks learned by Lloyd's iteration with filtering.

Every partition builds kd-trees over its parts once, one for each Arrow batch and part position, with the bounding box, sum and count
of every node, and writes them. A round goes down the trees with the entries of the codebook: an entry that is further from the
whole box than another is left out, and where one entry is left its node is assigned at once by the cached sum and count. Only
leaves with several entries left are compared vector by vector. All arithmetic is in whole numbers, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrust.llm.common import written
from fieldtrust.llm.vector_blocks import finite, first_vectors, floor_means, matrix, pack, partial_rows, summed, unpack, whole

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 8, 16, 6, 4096, 16
#: Up to so many labels their totals are broadcast (counted first); beyond it they are joined by a shuffle.
BROADCAST_LABELS = 100_000


@dataclass
class Tree:
    """A kd-tree in heap order: node i has the children 2i + 1 and 2i + 2, the last level holds the leaves."""

    points: np.ndarray  # in tree order
    order: np.ndarray  # row of each point
    bounds: list[np.ndarray]  # by level, where its nodes begin and the last one ends
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def levels(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """Where the nodes of each level begin: every node is halved until leaves hold at most ``leaf`` rows."""
    out = [np.array([0, n])]
    while n and np.diff(out[-1]).max() > leaf:
        b = out[-1]
        out.append(np.insert(b, np.arange(1, len(b)), (b[:-1] + b[1:]) // 2))
    return out


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of ``points`` (one row at least), each node halved along the widest side of its box."""
    n = len(points)
    bounds, order = levels(n, leaf), np.arange(n)
    low, high, sums = [], [], []
    for depth, b in enumerate(bounds):
        p = points[order]
        low.append(np.minimum.reduceat(p, b[:-1]))
        high.append(np.maximum.reduceat(p, b[:-1]))
        sums.append(np.add.reduceat(p, b[:-1]))
        if depth + 1 < len(bounds):
            node = np.repeat(np.arange(len(b) - 1), np.diff(b))
            widest = (high[-1] - low[-1]).argmax(axis=1)
            order = order[np.lexsort((p[np.arange(n), widest[node]], node))]
    return Tree(points[order], order, bounds, *(np.concatenate(x) for x in (low, high, sums)))


def filtered(tree: Tree, entries: np.ndarray, label: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of the rows nearest to each entry (ties to the lower index); with ``label`` also the entry of each row."""
    k = len(entries)
    sums, counts = np.zeros_like(entries), np.zeros(k, np.int64)
    codes = np.zeros(len(tree.points), np.int64)
    squares = (entries * entries).sum(axis=1)
    nodes, first = np.zeros(1, np.int64), 0
    left = np.ones((1, k), bool)
    every = np.arange(k)
    for depth, b in enumerate(tree.bounds):
        low, high = tree.low[first + nodes], tree.high[first + nodes]
        middle = (low + high) / 2.0
        near = ((entries[None].astype(float) - middle[:, None]) ** 2).sum(axis=2)
        best = np.where(left, near, np.inf).argmin(axis=1)
        # |z - p|^2 - |best - p|^2 is linear in p: least at the corner of the box towards z
        way = entries[None] - entries[best][:, None]
        least = squares[None] - squares[best][:, None] - 2 * (np.where(way > 0, high[:, None], low[:, None]) * way).sum(axis=2)
        left &= ~((least > 0) | ((least == 0) & (every > best[:, None])))
        alone = left.sum(axis=1) == 1
        if alone.any():
            owner, own = left[alone].argmax(axis=1), nodes[alone]
            np.add.at(sums, owner, tree.sums[first + own])
            np.add.at(counts, owner, b[own + 1] - b[own])
            if label:
                for i, e in zip(own.tolist(), owner.tolist(), strict=True):
                    codes[b[i] : b[i + 1]] = e
        nodes, left = nodes[~alone], left[~alone]
        if not len(nodes):
            break
        if depth + 1 < len(tree.bounds):
            first += len(b) - 1
            nodes, left = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(left, 2, axis=0)
            continue
        size = b[nodes + 1] - b[nodes]
        of = np.repeat(np.arange(len(nodes)), size)
        rows = np.repeat(b[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        p = tree.points[rows]
        gap = np.stack([((p - e) ** 2).sum(axis=1) for e in entries], axis=1)
        mine = np.where(left[of], gap, np.iinfo(np.int64).max).argmin(axis=1)
        np.add.at(sums, mine, p)
        counts += np.bincount(mine, minlength=k)
        codes[rows] = mine
    out = np.zeros(len(codes), np.int64)
    out[tree.order] = codes
    return sums, counts, out


def _forest(kept: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """One row for each Arrow batch: ids, labels and the trees of all part positions."""
    w, kind = width // parts, kept.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = whole(matrix(b.column("embedding"), width), scale, width).reshape(-1, parts, w)
            trees = [build(np.ascontiguousarray(x[:, p])) for p in range(parts)]
            columns = [pack(np.stack([getattr(t, f) for t in trees])) for f in ("points", "order", "low", "high", "sums")]
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([b.num_rows], pa.int32()), *[pa.array([raw], pa.binary()) for raw, _ in columns], pa.array([[s for _, s in columns]], pa.list_(pa.int32()))], ["ids", "labels", "n", "points", "order", "low", "high", "sums", "sizes"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kind)), T.StructField("n", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("points", "order", "low", "high", "sums")], T.StructField("sizes", T.ArrayType(T.IntegerType()))])
    return written(kept.mapInArrow(run, schema), "code-trees")


def _trees(batch: pa.RecordBatch, parts: int, w: int) -> Iterator[tuple[int, list[Tree]]]:
    """The trees of each row of ``batch`` by its place; bytes are made arrays one row at a time."""
    at = {c: batch.column(c) for c in ("n", "points", "order", "low", "high", "sums", "sizes")}
    for i in range(batch.num_rows):
        n, sizes = at["n"][i].as_py(), at["sizes"][i].as_py()
        bounds = levels(n)
        nodes = sum(len(b) - 1 for b in bounds)
        shapes = [(parts, n, w), (parts, n), *[(parts, nodes, w)] * 3]
        arrays = [unpack(at[c][i].as_buffer(), s, *shape) for c, s, shape in zip(("points", "order", "low", "high", "sums"), sizes, shapes, strict=True)]
        yield i, [Tree(arrays[0][p], arrays[1][p], bounds, arrays[2][p], arrays[3][p], arrays[4][p]) for p in range(parts)]


def learn(forest: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """``books`` (parts, entries, width of a part) after ``rounds`` rounds over the trees; a task sends one row for each number of the books."""
    parts, k, w = books.shape

    shape = (parts, k, w + 1)

    def totals(entries: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.int64)
            for b in batches:
                for _, trees in _trees(b, parts, w):
                    for p, tree in enumerate(trees):
                        s, c, _ = filtered(tree, entries[p])
                        total[p, :, :w] += s
                        total[p, :, w] += c
            yield partial_rows(total)

        return summed(forest.select("n", "points", "order", "low", "high", "sums", "sizes").mapInArrow(run, "k long, s long"), shape)

    for _ in range(rounds):
        t = totals(books)
        books = floor_means(books, t[..., :w], t[..., w])
    return books


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to ``(vec_id, code, error, label_error, codebooks_sha256)``, one row for each vector kept.

    Vectors that are null or hold null or non-finite components are dropped. The length is that of the vector with the smallest id
    whose length is a positive multiple of ``parts``; vectors of other lengths cannot be cut alike and are dropped too. Null ids and
    labels are kept (labels: one group); a null id is no first entry while others are left. Rows that repeat an id count each; of
    equal ids the smaller vector comes first. With fewer vectors than ``entries`` the codebooks are as small as that. Whole numbers
    beyond about 2^27 (at 64 components), whose distances no long holds, are held there; a ``label_error`` beyond a long is null.
    An empty table gives an empty table; further columns are left out.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label").where(finite(F.col("embedding")))
    order = [F.col("vec_id").asc_nulls_last()]
    size = F.size("embedding")
    first = v.where((size > 0) & (size % parts == 0)).orderBy(*order, "embedding").select(size.alias("d")).first()
    width = first.d if first else parts
    v = v.where(size == width)
    seeds = first_vectors(v, order, entries, scale, width)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, width // parts).swapaxes(0, 1))
    forest = _forest(v, width, parts, scale)
    books = learn(forest, books, rounds) if len(seeds) else books
    digits = [f"{i:02x}" for i in range(max(1, books.shape[1]))]
    kind = v.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = width // parts
        for b in batches:
            for i, trees in _trees(b, parts, w):
                picked = [filtered(tree, books[p], label=True)[2] for p, tree in enumerate(trees)]
                error = np.zeros(len(picked[0]), np.int64)
                for p, tree in enumerate(trees):
                    error[tree.order] += ((tree.points - books[p][picked[p][tree.order]]) ** 2).sum(axis=1)
                code = ["".join(digits[j] for j in row) for row in np.stack(picked, axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = written(forest.mapInArrow(run, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])), "codes")
    # a sum of longs may pass a long: exact in decimals, null where it does
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = written(coded.groupBy("label").agg(total.alias("e")).select(F.col("label").alias("of"), F.expr("try_cast(e as bigint)").alias("label_error")), "code-label-errors")
    if totals.count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    numbers = ",".join(map(str, books.ravel().tolist()))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _oracle(rounds: int = ROUNDS) -> str:
    """The same in SQL, every part against every entry: one CTE for each round, on long rows (part, row, position)."""
    fdiv = "(CAST(sum(p.x) AS BIGINT) - ((CAST(sum(p.x) AS BIGINT) % count(*)) + count(*)) % count(*)) // count(*)"
    ctes = [
        """kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""wide AS MATERIALIZED (SELECT r, vec_id, label, part, list_transform(range(8), lambda j: CAST(floor({SCALE} * CAST(embedding[part * 8 + j + 1] AS DOUBLE)) AS BIGINT)) AS xs FROM kept, range({PARTS}) t(part))""",
        "parts AS MATERIALIZED (SELECT r, part, j, xs[j + 1] AS x FROM wide, range(8) t(j))",
        f"book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, xs AS zs FROM wide WHERE r <= {ENTRIES})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""near{i} AS MATERIALIZED (SELECT r, part, CAST(min(d * {ENTRIES} + entry) AS BIGINT) AS best FROM (SELECT w.r, w.part, b.entry,
        list_sum(list_transform(range(1, 9), lambda j: (w.xs[j] - b.zs[j]) * (w.xs[j] - b.zs[j]))) AS d FROM wide w JOIN book{i} b ON w.part = b.part) GROUP BY r, part)""")
        if i < rounds:
            ctes.append(f"""book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.zs, b.zs) AS zs FROM book{i} b LEFT JOIN (SELECT part, entry, list(x ORDER BY j) AS zs FROM
            (SELECT p.part, n.best % {ENTRIES} AS entry, p.j, {fdiv} AS x FROM parts p JOIN near{i} n ON p.r = n.r AND p.part = n.part GROUP BY p.part, n.best % {ENTRIES}, p.j) GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)""")
    ctes.append(f"""coded AS (SELECT r, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM near{rounds} GROUP BY r)""")
    ctes.append(f"book AS (SELECT sha256(string_agg(array_to_string(zs, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds})")
    return "WITH " + ",\n".join(ctes) + " SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, book.h AS codebooks_sha256 FROM kept k JOIN coded c ON k.r = c.r, book"


ORACLE_SQL = _oracle()
