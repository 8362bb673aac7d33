"""Minimum-cost-flow resharding.

The old layout has ``old_shards`` shards, each holding blocks of rows of like size. The new one has ``new_shards`` shards
whose row counts differ by one at most. A flow from blocks to new shards moves rows; a row that stays in the shard it is in
costs nothing, one that moves costs its block's mean bytes. The cheapest flow is solved over the blocks (their number is a
parameter, not the data's), then every row finds its place from its position in its block.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldtrust.llm.common import scratch

ROW_OVERHEAD = 16
SIZE_CLASSES = 24
FILE_ROWS = 5000


class Flow:
    """Minimum-cost maximum flow by shortest augmenting paths with potentials; all costs are 0 or more."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, capacity: int, cost: float) -> int:
        k = len(self.to)
        self.out[a].append(k)
        self.out[b].append(k + 1)
        self.to += [b, a]
        self.left += [capacity, 0]
        self.cost += [cost, -cost]
        return k

    def solve(self, source: int, sink: int) -> int:
        n, total = len(self.out), 0
        potential = [0.0] * n
        while True:
            far, via = [float("inf")] * n, [-1] * n
            far[source], heap = 0.0, [(0.0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for k in self.out[a]:
                    b = self.to[k]
                    if self.left[k] and (x := d + max(0.0, self.cost[k] + potential[a] - potential[b])) < far[b] - 1e-9:
                        far[b], via[b] = x, k
                        heapq.heappush(heap, (x, b))
            if via[sink] < 0:
                return total
            for a in range(n):
                potential[a] += min(far[a], far[sink])
            # push along every shortest path that is still open before measuring distances again
            while True:
                path, b, seen = [], sink, 0
                while b != source and via[b] >= 0 and seen <= n:
                    path.append(via[b])
                    b, seen = self.to[via[b] ^ 1], seen + 1
                step = min((self.left[k] for k in path), default=0)
                if b != source or not step:
                    break
                for k in path:
                    self.left[k] -= step
                    self.left[k ^ 1] += step
                total += step


def solve_transfers(blocks: list[tuple[int, int, int, int]], new_shards: int) -> list[tuple[int, int, int, int, int]]:
    """``blocks``: (old shard, class, rows, bytes). Returns (old shard, class, first row, end row, new shard), rows counted within the block; what stays comes first."""
    blocks = sorted(b for b in blocks if b[2])
    rows = sum(b[2] for b in blocks)
    capacity = [rows // new_shards + (j < rows % new_shards) for j in _by_holding(blocks, rows, new_shards)]
    source, hub, sink = 0, 1, 2
    flow = Flow(3 + len(blocks) + new_shards)
    shard = lambda j: 3 + len(blocks) + j
    stays, moves = {}, {}
    for i, (old, _, n, size) in enumerate(blocks):
        flow.arc(source, 3 + i, n, 0.0)
        if old < new_shards:
            stays[i] = flow.arc(3 + i, shard(old), n, 0.0)
        moves[i] = flow.arc(3 + i, hub, n, size / n)
    takes = [flow.arc(hub, shard(j), rows, 0.0) for j in range(new_shards)]
    for j in range(new_shards):
        flow.arc(shard(j), sink, capacity[j], 0.0)
    if flow.solve(source, sink) != rows:
        raise RuntimeError("the capacities do not hold the rows")
    plan, wanting = [], [[j, flow.left[takes[j] ^ 1]] for j in range(new_shards)]
    for i, (old, size_class, n, _) in enumerate(blocks):
        at = flow.left[stays[i] ^ 1] if i in stays else 0
        if at:
            plan.append((old, size_class, 0, at, old))
        out = flow.left[moves[i] ^ 1]
        while out:
            while not wanting[0][1]:
                wanting.pop(0)
            step = min(out, wanting[0][1])
            plan.append((old, size_class, at, at + step, wanting[0][0]))
            at, out = at + step, out - step
            wanting[0][1] -= step
    return plan


def _by_holding(blocks: list, rows: int, new_shards: int) -> list[int]:
    """The rank of each new shard by what it holds now: the fullest get the odd rows."""
    held = [0] * new_shards
    for old, _, n, _ in blocks:
        if old < new_shards:
            held[old] += n
    rank = [0] * new_shards
    for k, j in enumerate(sorted(range(new_shards), key=lambda j: (-held[j], j))):
        rank[j] = k
    return rank


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


PLAN = T.StructType([T.StructField(c, T.LongType()) for c in ("old_shard", "size_class", "first", "end", "shard")])


def reshard(docs: DataFrame, old_shards: int = 32, new_shards: int = 40, old_shard: Column | None = None, salts: int = 64) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, size, text_crc32, old_shard, size_class, shard, slot, moved, touched, text)``.

    The old layout is ``old_shard`` or, by default, a hash of id and text. ``touched`` are the rows of blocks that lose
    some; only these carry their ``text`` along, of all others nothing but ids, sizes and checksums is shuffled. Positions are counted in (block, salt) windows whose offsets come from a table of at most
    ``old_shards * SIZE_CLASSES * salts`` counts, so no task numbers more than a sliver of the rows. A null text has the
    size 16 and checksum 0; rows with a null id or repeated ids are placed like any other; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    old = old_shard if old_shard is not None else F.pmod(F.xxhash64("doc_id", "text"), F.lit(old_shards))
    size = text_size(F.col("text"))
    rows = docs.select(
        "doc_id",
        size.alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        old.cast("long").alias("old_shard"),
        F.least(F.floor(F.log2(size.cast("double"))), F.lit(SIZE_CLASSES - 1)).cast("long").alias("size_class"),
        F.pmod(F.xxhash64("text", "doc_id", F.lit(7)), F.lit(salts)).alias("salt"),
        "text",
    )
    # what moves is taken from the end of a block, and blocks hold like sizes
    counts = rows.groupBy("old_shard", "size_class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    counts = counts.toPandas().sort_values(["old_shard", "size_class", "salt"]).reset_index(drop=True)
    per_block = counts.groupby(["old_shard", "size_class"], as_index=False)[["n", "bytes"]].sum()
    plan = solve_transfers([tuple(map(int, x)) for x in per_block.itertuples(index=False)], new_shards)
    losing = sorted({a * SIZE_CLASSES + b for a, b, _, _, j in plan if j != a})
    touched = (F.col("old_shard") * SIZE_CLASSES + F.col("size_class")).isin(losing) if losing else F.lit(False)
    rows = rows.withColumn("touched", touched).withColumn("text", F.when(F.col("touched"), F.col("text")))
    counts["before"] = counts.groupby(["old_shard", "size_class"])["n"].cumsum() - counts["n"]
    ends, frames = [0] * new_shards, []
    for a, b, first, end, j in plan:
        frames.append((a, b, first, end, j, ends[j]))
        ends[j] += end - first
    # transfers cut by salt: (block, salt) pieces with the slot of their first row; bounded by the parameters
    pieces = []
    by_block: dict = {}
    for x in frames:
        by_block.setdefault(x[:2], []).append(x)
    for r in counts.itertuples(index=False):
        lo, hi = int(r.before), int(r.before + r.n)
        cut = [(max(lo, x[2]) - lo, min(hi, x[3]) - lo, x[4], x[5] + max(lo, x[2]) - x[2]) for x in by_block[(r.old_shard, r.size_class)] if x[2] < hi and x[3] > lo]
        pieces.append((int(r.old_shard), int(r.size_class), int(r.salt), cut))
    piece = T.StructType([T.StructField(c, T.LongType()) for c in ("first", "end", "shard", "slot")])
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("old_shard", "size_class", "salt")] + [T.StructField("pieces", T.ArrayType(piece))])
    placed = F.broadcast(spark.createDataFrame(pieces, kind))
    w = Window.partitionBy("old_shard", "size_class", "salt").orderBy("doc_id", "text_crc32")
    hit = F.element_at(F.filter("pieces", lambda p: (p["first"] <= F.col("k")) & (F.col("k") < p["end"])), 1)
    return (
        rows.withColumn("k", (F.row_number().over(w) - 1).cast("long"))
        .join(placed, ["old_shard", "size_class", "salt"])
        .withColumn("hit", hit)
        .select(
            "doc_id", "size", "text_crc32", "old_shard", "size_class",
            F.col("hit.shard").cast("int").alias("shard"),
            (F.col("hit.slot") + F.col("k") - F.col("hit.first")).alias("slot"),
            (F.col("hit.shard") != F.col("old_shard")).alias("moved"),
            "touched", "text",
        )
    )


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str) -> DataFrame:
    """Write the rows of every block that loses rows below ``path`` by new shard, a shard in several files; returns them as read from there.

    Blocks that keep all their rows aren't rewritten. ``placed`` is what ``reshard(docs)`` returns: its touched rows bring
    their own text, so rows without an id and repeated ones are written as often as they occur.
    """
    out = placed.where("touched").select("doc_id", "text", "slot", "old_shard", "size_class", "moved", "shard")
    dealt = out.repartition("shard", F.floor(F.col("slot") / FILE_ROWS)).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def resharded(docs: DataFrame, old_shards: int = 32, new_shards: int = 40) -> DataFrame:
    """The new layout, ``(doc_id, size, text_crc32, shard, slot, old_shard, moved)``: rewritten rows as their files hold them, then the untouched blocks."""
    placed = reshard(docs, old_shards, new_shards)
    files = rewrite_affected(docs, placed, f"{scratch(docs.sparkSession)}/reshard-files-{uuid.uuid4().hex}")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32")
    names = ["doc_id", "size", "text_crc32", "shard", "slot", "old_shard", "moved"]
    new = files.select("doc_id", text_size(F.col("text")).alias("size"), crc, *names[3:])
    return new.unionByName(placed.where("not touched").select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resharded(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
