"""Centroid clustering with Yinyang bounds.

The centroids are put into groups once. Every vector keeps an upper bound on the distance to its centroid and one lower bound for
each group on the distances to the group's other centroids; bounds move by how far centroids have moved. A vector whose upper
bound is under all its lower bounds is passed over; otherwise the upper bound is made exact, groups whose bound stays above it
are passed over, and the centroids of the groups left are scanned exactly. Distances are whole numbers; bounds are their roots with
a margin for rounding, so a tie is always scanned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import written
from fieldtrust.llm.vector_blocks import finite, first_vectors, floor_means, matrix, pack, partial_rows, summed, unpack, whole

CLUSTERS, GROUPS, ROUNDS, SCALE, WIDTH = 16, 4, 3, 64, 64
BLOCK = "ids array<long>, n int, vectors binary, size int, cluster binary, upper binary, lower binary, sums binary, counts array<long>, scanned long"


def margin(x: np.ndarray | float) -> np.ndarray | float:
    return 1e-6 + 1e-9 * x


def grouped(centroids: np.ndarray, groups: int, steps: int = 5) -> np.ndarray:
    """The group of each centroid, by a few rounds of Lloyd's iteration on the centroids; no group is empty."""
    k = len(centroids)
    g = max(1, min(groups, k))
    x = centroids.astype(np.float64)
    middle, of = x[np.arange(g) * k // g].copy(), np.arange(k) * g // max(1, k)
    for _ in range(steps):
        now = ((x[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        if len(np.unique(now)) < g:  # equal centroids: keep the groups there are
            break
        of = now
        middle = np.stack([x[of == j].mean(axis=0) for j in range(g)])
    return of


def gaps(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((x - centroid) ** 2).sum(axis=1)


def first_pass(x: np.ndarray, centroids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignment against all centroids, with its bounds."""
    d = np.stack([gaps(x, c) for c in centroids], axis=1)
    a = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(x)), a].astype(np.float64))
    rest = np.sqrt(d.astype(np.float64))
    rest[np.arange(len(x)), a] = np.inf
    return a, upper, np.stack([rest[:, of == g].min(axis=1) for g in range(of.max() + 1)], axis=1), d.size


def later_pass(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignment to ``new`` from that to ``old``: the global filter, then that of groups, then exact scans; also how many distances were taken."""
    moved = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64))
    a, upper = a.copy(), upper + moved[a] + margin(moved[a])
    far = np.array([moved[of == g].max() for g in range(of.max() + 1)])
    lower = lower - far - margin(far)
    open_ = np.flatnonzero(upper + margin(upper) >= lower.min(axis=1))
    exact = ((x[open_] - new[a[open_]]) ** 2).sum(axis=1)
    taken = len(open_)
    upper[open_] = np.sqrt(exact.astype(np.float64))
    still = upper[open_] + margin(upper[open_]) >= lower[open_].min(axis=1)
    rows, best = open_[still], exact[still]
    was, kept, at = a[rows], best.copy(), a[rows].copy()
    scan = upper[rows][:, None] + margin(upper[rows])[:, None] >= lower[rows]
    first, second = np.full(scan.shape, np.inf), np.full(scan.shape, np.inf)
    for g in range(scan.shape[1]):
        mine, members = np.flatnonzero(scan[:, g]), np.flatnonzero(of == g)
        if not len(mine):
            continue
        d = np.stack([gaps(x[rows[mine]], new[c]) for c in members], axis=1)
        taken += d.size
        low, which = d.min(axis=1), members[d.argmin(axis=1)]  # of ties the smaller number comes first
        better = (low < best[mine]) | ((low == best[mine]) & (which < at[mine]))
        best[mine[better]], at[mine[better]] = low[better], which[better]
        roots = np.sort(np.sqrt(d.astype(np.float64)), axis=1)
        first[mine, g] = roots[:, 0]
        second[mine, g] = roots[:, 1] if len(members) > 1 else np.inf
    # the row's own centroid is the nearest of its group, and no bound of the others
    own = of[at][:, None] == np.arange(scan.shape[1])
    lower[rows] = np.where(scan, np.where(own, second, first), lower[rows])
    gone = np.flatnonzero(at != was)
    lower[rows[gone], of[was[gone]]] = np.minimum(lower[rows[gone], of[was[gone]]], np.sqrt(kept[gone].astype(np.float64)))
    a[rows], upper[rows] = at, np.sqrt(best.astype(np.float64))
    return a, upper, lower, taken


def _block(ids: pa.Array, n: int, raw: bytes, size: int, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: int, k: int) -> pa.RecordBatch:
    sums = np.stack([x[a == c].sum(axis=0) for c in range(k)])
    values = [
        pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), pa.array([n], pa.int32()), pa.array([raw], pa.binary()), pa.array([size], pa.int32()), pa.array([a.astype("<i4").tobytes()], pa.binary()), pa.array([upper.tobytes()], pa.binary()),
        pa.array([lower.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()), pa.array([np.bincount(a, minlength=k)], pa.list_(pa.int64())), pa.array([scanned], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in BLOCK.split(", ")])


def _state(b: pa.RecordBatch, i: int, width: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = b.column("n")[i].as_py()
    x = unpack(b.column("vectors")[i].as_buffer(), b.column("size")[i].as_py(), n, width)
    upper, lower = (np.frombuffer(b.column(c)[i].as_buffer(), np.float64) for c in ("upper", "lower"))
    return x, np.frombuffer(b.column("cluster")[i].as_buffer(), "<i4").astype(np.int64), upper, lower.reshape(n, groups)


def _means(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    k, w = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, w + 1), np.int64)
        for b in batches:
            for raw, counts in zip(b.column("sums"), b.column("counts"), strict=True):
                total[:, :w] += np.frombuffer(raw.as_buffer(), np.int64).reshape(k, w)
                total[:, w] += np.array(counts.as_py())
        yield partial_rows(total)

    t = summed(blocks.select("sums", "counts").mapInArrow(run, "k long, s long"), (k, w + 1))
    return floor_means(centroids, t[:, :w], t[:, w])


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, groups: int = GROUPS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """``vectors(vec_id, embedding)`` to ``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row for each vector kept.

    Kept are vectors of exactly ``width`` components, none null or non-finite. First centroids are the vectors with the smallest
    sha256 of ``1:<vec_id>``; of equal ids the smaller vector comes first, null ids last. With fewer vectors than ``clusters`` there
    are as many centroids as vectors. Whole numbers beyond about 2^27, whose distances no long holds, are held there; sums of
    distances beyond a long are null. Rows that repeat an id count each. An empty table gives an empty table; further columns are
    left out.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(finite(F.col("embedding")) & (F.size("embedding") == width))
    mark = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    centroids = first_vectors(v, [mark.asc_nulls_last()], clusters, scale, width)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    of = grouped(centroids, groups)
    k, n_groups = len(centroids), int(of.max()) + 1
    seeds = centroids

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = whole(matrix(b.column("embedding"), width), scale, width)
                yield _block(b.column("vec_id"), b.num_rows, *pack(x), x, *first_pass(x, seeds, of), k)

    def step(old: np.ndarray, new: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    x, a, upper, lower = _state(b, i, width, n_groups)
                    found = later_pass(x, a, upper, lower, old, new, of)
                    yield _block(b.column("ids")[i].values, len(x), b.column("vectors")[i].as_py(), b.column("size")[i].as_py(), x, *found, k)

        return run

    blocks = written(v.mapInArrow(begin, BLOCK), "yinyang-0")
    for i in range(1, rounds + 1):
        new = _means(blocks, centroids)
        blocks = written(blocks.mapInArrow(step(centroids, new), BLOCK), f"yinyang-{i}")
        centroids = new

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 2), np.int64)  # high and low halves: a sum of longs may pass a long
        for b in batches:
            for i in range(b.num_rows):
                x, a, _, _ = _state(b, i, width, n_groups)
                d = ((x - centroids[a]) ** 2).sum(axis=1)
                np.add.at(total, (a, 0), d >> 32)
                np.add.at(total, (a, 1), d & 0xFFFFFFFF)
        yield partial_rows(total)

    halves = summed(blocks.mapInArrow(spread, "k long, s long"), (k, 2))
    inertia = [(int(h) << 32) + int(low) for h, low in halves]
    fits = lambda s: s if s < 2**63 else None
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per, whole_sum = [fits(s) for s in inertia], fits(sum(inertia))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, a, _, _ = _state(b, i, width, n_groups)
                own = a.tolist()
                values = [b.column("ids")[i].values, pa.array(a, pa.int32()), pa.array(((x - centroids[a]) ** 2).sum(axis=1), pa.int64()), pa.array([per[c] for c in own], pa.int64()), pa.array([whole_sum] * len(own), pa.int64()), pa.array([marks[c] for c in own], pa.string())]
                yield pa.RecordBatch.from_arrays(values, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(rows, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _oracle(rounds: int = ROUNDS) -> str:
    """The same in SQL, every vector against every centroid: one CTE for each round."""
    fdiv = "(CAST(sum(p.x) AS BIGINT) - ((CAST(sum(p.x) AS BIGINT) % count(*)) + count(*)) % count(*)) // count(*)"
    ctes = [
        f"""wide AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS xs FROM embeddings
        WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"long AS MATERIALIZED (SELECT r, j, xs[j + 1] AS x FROM wide, range({WIDTH}) t(j))",
        f"mid0 AS MATERIALIZED (SELECT r - 1 AS c, xs AS zs FROM wide WHERE r <= {CLUSTERS})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""near{i} AS MATERIALIZED (SELECT r, CAST(min(d * {CLUSTERS} + c) AS BIGINT) AS best FROM (SELECT w.r, m.c, list_sum(list_transform(range(1, {WIDTH + 1}), lambda j: (w.xs[j] - m.zs[j]) * (w.xs[j] - m.zs[j]))) AS d FROM wide w, mid{i} m) GROUP BY r)""")
        if i < rounds:
            ctes.append(f"""mid{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.zs, o.zs) AS zs FROM mid{i} o LEFT JOIN (SELECT c, list(x ORDER BY j) AS zs FROM
            (SELECT n.best % {CLUSTERS} AS c, p.j, {fdiv} AS x FROM long p JOIN near{i} n ON p.r = n.r GROUP BY n.best % {CLUSTERS}, p.j) GROUP BY c) m ON o.c = m.c)""")
    return "WITH " + ",\n".join(ctes) + f""" SELECT w.vec_id, CAST(n.best % {CLUSTERS} AS INTEGER) AS cluster, n.best // {CLUSTERS} AS distance, CAST(sum(n.best // {CLUSTERS}) OVER (PARTITION BY n.best % {CLUSTERS}) AS BIGINT) AS cluster_inertia,
    CAST(sum(n.best // {CLUSTERS}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.zs, ',')) AS centroid_sha256 FROM wide w JOIN near{rounds} n ON w.r = n.r JOIN mid{rounds} m ON n.best % {CLUSTERS} = m.c"""


ORACLE_SQL = _oracle()
