"""Near-duplicate texts: SimHash links first, then every pair with a Jaccard similarity of 0.8 or more on word shingles.

SimHash finds what is all but equal: fingerprints within two bits are linked through their pivot tables, and such a link counts
where the texts' sets of shingles are alike. At a similarity of 0.8 fingerprints differ by some ten bits of 64, which no search by
bits can afford, so what is left is found by the sets: two sets that alike share a shingle among the first ``n - ceil(0.8 n) + 1`` of
each in any order common to all, so texts that share none of these are never compared and no pair is lost (shingles are 64-bit
hashes). Shingles that a sample finds in several texts come last in the order; that saves work and changes no result. Groups whose
texts are all linked already are dropped, of groups with the same members one is kept, and the rest are compared tile by tile: by
parity sketches first, which differ in no more bits than the sets do in shingles. The pairs that these leave make clusters; as two
texts meet once for each first shingle that they share, of clusters with the same members one is kept, and only there the texts are
sent and compared by their sets, with products of 0/1 matrices. Of a pair of tiles only a spanning forest of its links leaves the
task, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm import chunks as ch
from fieldtrust.llm.common import release, short_batches, written
from fieldtrust.llm.components import connected_components
from fieldtrust.llm.simhash import _Forest, links, majority, shingle_hashes

WIDTH = 5
SAMPLE = 4000
CHUNK_SHINGLES = 25_000  # a row of some 200 KB: the JVM moves larger arrays badly
RANGE_BYTES = 4 << 20
TILE_SHINGLES = 250_000
TILE_ROWS = 1024
COLUMNS = 4096
#: Rows of keys (some 40 bytes each) up to which a list of texts is broadcast rather than the texts shuffled.
BROADCAST_ROWS = 250_000
KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of ``text``, ascending; fewer words than ``width`` are one shingle, none are none."""
    return np.unique(shingle_hashes(text, width))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity is 4/5 or more; two empty sets are alike."""
    small, large = sorted((len(x), len(y)))
    if 5 * small < 4 * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (small + large - both)


def first_shingles(x: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of ``x`` in the order (count in the sample, hash)."""
    if not len(x):
        return np.zeros(1, np.uint64)
    size = len(x) - (4 * len(x) + 4) // 5 + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
        x = x[np.argsort(np.where(common[at] == x, counts[at], 0), kind="stable")]
    return x[:size]


def band(n: int) -> int:
    """Sizes that sets of a similarity of 0.8 can have lie in one band or in two that follow each other."""
    return int(np.floor(np.log(max(n, 1)) / np.log(1.26)))


def sketch(x: np.ndarray) -> bytes:
    """A bit for each of one to two places a shingle, set where an odd number of shingles fall; so two sketches of one length differ in no more bits than their sets in shingles."""
    m = max(256, 1 << len(x).bit_length())
    return np.packbits(np.bincount((x & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).tobytes()


def _folded(marks: list[bytes], size: int) -> np.ndarray:
    """Sketches cut down to ``size`` bytes, as rows of 1 and -1: a place of the shorter one takes all places that agree with it modulo its length."""
    rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, size), axis=0) for m in marks])
    return 1 - 2 * np.unpackbits(rows, axis=1).astype(np.float32)


def candidates(left: list, right: list | None) -> np.ndarray:
    """Which members (``node, label, low, n, sketch``) of two tiles, or of one, may be alike and have other labels, as a matrix."""
    own = right is None
    right = left if own else right
    size = min(len(m[4]) for m in (*left, *right))
    a = _folded([m[4] for m in left], size)
    b = a if own else _folded([m[4] for m in right], size)
    apart = (8 * size - a @ b.T) / 2
    col = lambda side, k, kind: np.array([m[k] for m in side], kind)
    may = 9 * apart <= col(left, 3, np.int64)[:, None] + col(right, 3, np.int64)[None, :]
    may &= (col(left, 1, np.int64)[:, None] != col(right, 1, np.int64)[None, :]) & ~(col(left, 2, bool)[:, None] & col(right, 2, bool)[None, :])
    return may


def partners(left: list, right: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Of two tiles, or of one, which members may have an alike member of another label."""
    may = candidates(left, right)
    return may.any(axis=1), may.any(axis=0)


def clusters(may: np.ndarray, own: bool) -> np.ndarray:
    """The clusters that a matrix of pairs connects, as the least place of each; the columns' places follow the rows' unless both are one tile's (``own``)."""
    rows, columns = may.shape
    names = np.arange(rows if own else rows + columns)
    while True:
        a, b = names[:rows], names[-columns:]
        near = np.where(may, b[None, :], len(names)).min(axis=1), np.where(may, a[:, None], len(names)).min(axis=0)
        new = np.minimum(names, np.minimum(*near) if own else np.concatenate(near))
        new = new[new]
        if (new == names).all():
            return names
        names = new


def _small(keys: DataFrame) -> DataFrame:
    """A written list of keys, marked for broadcast where it is small: then the texts that it is joined with stay where they are."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more of some thousand sampled texts hold, ascending, and in how many."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)).dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, width).view(np.int64))], ["h"])

    got = some.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3").toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """Chunks of some hundred texts ``(chunk, nodes, fps, sizes, counts, firsts, marks)``: hashes, fingerprints, numbers of distinct shingles, how many first shingles and which, and sketches."""
    common, known = _common(docs, width)
    kinds = "chunk long, nodes binary, fps binary, sizes binary, counts binary, firsts binary, marks array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier tasks left in a worker that Spark uses again
        chunk, held = TaskContext.get().partitionId() << 24, []

        def full() -> pa.RecordBatch:
            node, fp, size, firsts, marks = zip(*held, strict=True)
            row = [np.array(node, np.int64), np.array(fp, np.uint64), np.array(size, np.int64), np.array(list(map(len, firsts)), np.int64), np.concatenate(firsts)]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.array([x.tobytes()], pa.binary()) for x in row), pa.array([marks], pa.list_(pa.binary()))], [c.split()[0] for c in kinds.split(", ")])

        n = 0
        for b in batches:
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = shingle_hashes(t, width)
                x = np.unique(h)
                held.append((node, majority(h), len(x), first_shingles(x, common, known), sketch(x)))
                n += len(held[-1][3])
                if n >= CHUNK_SHINGLES:
                    yield full()
                    chunk, held, n = chunk + 1, [], 0
        if held:
            yield full()

    return docs.select("node", "text").mapInArrow(run, kinds)


def _unpacked(r) -> tuple[np.ndarray, ...]:
    return (*(np.frombuffer(r[c], np.int64) for c in ("nodes", "fps", "sizes", "counts")), np.frombuffer(r["firsts"], np.uint64))


def _nodes(prints: DataFrame) -> DataFrame:
    """``(node, fp, n)`` by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], np.int64)) for c in ("nodes", "fps", "sizes")], ["node", "fp", "n"])

    return prints.select("nodes", "fps", "sizes").mapInArrow(run, "node long, fp long, n long")


def _marks(prints: DataFrame) -> DataFrame:
    """``(node, mark)`` by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for nodes, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(nodes, np.int64)), pa.array(marks, pa.binary())], ["node", "mark"])

    return prints.select("nodes", "marks").mapInArrow(run, "node long, mark binary")


def _shared_firsts(prints: DataFrame) -> DataFrame:
    """``(first, node, n)`` of the first shingles that more than one text of the corpus has among its first.

    Nearly all are one text's alone. Chunks ask for their distinct ones, sorted and packed, and get a bit back for each.
    """
    total = prints.agg(F.sum(F.length("firsts"))).first()[0] or 0
    ranges = max(1, -(-total // RANGE_BYTES))

    def ask(frames):
        for pdf in frames:
            for r in pdf.to_dict("records"):
                nodes, _, _, counts, firsts = _unpacked(r)
                order = np.argsort(firsts, kind="stable")
                h, node = firsts[order], np.repeat(nodes, counts)[order]
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                many = np.minimum.reduceat(node, at) != np.maximum.reduceat(node, at)
                h = h[at]
                out = [(r["chunk"], k, ch.put_sorted(h[a:b]), np.packbits(many[a:b]).tobytes()) for k, a, b in ch.runs(h, ranges)]
                yield pd.DataFrame(out, columns=["chunk", "range", "keys", "many"])

    asked = prints.select("chunk", "nodes", "fps", "sizes", "counts", "firsts").mapInPandas(ask, "chunk long, range long, keys binary, many binary")
    told = written(ch.held_by_several(asked), "shingle-told")

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bits = dict(zip(right["range"], right["payload"], strict=True))
        out = []
        for r in left.to_dict("records"):
            nodes, _, sizes, counts, firsts = _unpacked(r)
            h, place = np.unique(firsts, return_inverse=True)
            shared = np.concatenate([ch.bits(bits[k], b - a) for k, a, b in ch.runs(h, ranges)])[place]
            out.append(pd.DataFrame({"first": firsts.view(np.int64)[shared], "node": np.repeat(nodes, counts)[shared], "n": np.repeat(sizes, counts)[shared]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["first", "node", "n"])

    rows = prints.drop("marks").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(answer, "first long, node long, n long")
    return rows.groupBy("first", "node").agg(F.max("n").alias("n"))


def _fingerprint_links(prints: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Edges ``(a, b)`` between texts whose fingerprints are linked and whose sets are alike: a forest's number of candidates, each verified."""
    nodes = _nodes(prints).groupBy("fp", "node").agg(F.max("n").alias("n"))
    reps = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("r")).select("fp", F.col("r.node").alias("node"), F.col("r.n").alias("n")), "shingle-fps")
    fits = F.least("na", "nb") * 5 >= F.greatest("na", "nb") * 4
    same = nodes.join(reps.select("fp", F.col("node").alias("a"), F.col("n").alias("na")), "fp").select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb"))
    end = lambda c: reps.select(F.col("fp").alias(f"f{c}"), F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    near = links(reps.select("fp")).toDF("fa", "fb").join(end("a"), "fa").join(end("b"), "fb").select("a", "b", "na", "nb")
    pairs = same.where("a <> b").unionAll(near).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(32))), "shingle-pairs")
    touched = written(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct(), "shingle-touched")
    texts = written(docs.join(_small(touched), "node", "left_semi").dropDuplicates(["node"]).select("node", "text"), "shingle-texts")
    # a text that very many are compared with is dealt to several tasks
    left = pairs.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(left, ["a", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for b in batches:
            keep = []
            for a, s, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if a != last:
                    last, x = a, shingles(s, width)
                keep.append(similar(x, shingles(t, width)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "shingle-links")


def tile_links(left: list, right: list | None) -> tuple[list[int], list[int]]:
    """A spanning forest of the alike pairs between two tiles, or within one; members are ``(node, label, low, set)``.

    Members of one label are linked already, and pairs of two ``low`` members are another group's work.
    """
    own = right is None
    right = left if own else right
    flat = np.concatenate([m[3] for m in left] + ([] if own else [m[3] for m in right]) or [np.empty(0, np.uint64)])
    values, n = np.unique(flat, return_counts=True)
    values = values[n > 1]

    def places(side: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(m[3]) for m in side], np.int64)
        whole = np.concatenate([m[3] for m in side])
        at = np.minimum(np.searchsorted(values, whole), max(len(values) - 1, 0))
        here = values[at] == whole if len(values) else np.zeros(len(whole), bool)
        return sizes, np.repeat(np.arange(len(side)), sizes)[here], at[here]

    sa, ra, ca = places(left)
    sb, rb, cb = (sa, ra, ca) if own else places(right)
    both = np.zeros((len(left), len(right)), np.float32)
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    for lo in range(0, len(values), COLUMNS):  # the 0/1 matrices stay a few megabytes
        parts = []
        for r, c, rows in ((ra, ca, len(left)), (rb, cb, len(right))):
            s = slice(*np.searchsorted(c, [lo, lo + COLUMNS]))
            m = np.zeros((rows, min(COLUMNS, len(values) - lo)), np.float32)
            m[r[s], c[s] - lo] = 1
            parts.append(m)
        both += parts[0] @ parts[1].T
    total = sa[:, None] + sb[None, :]
    alike = 9 * both >= 4 * total  # both / (total - both) >= 4/5
    label = lambda side: np.array([m[1] for m in side], np.int64)
    low = lambda side: np.array([m[2] for m in side], bool)
    alike &= (label(left)[:, None] != label(right)[None, :]) & ~(low(left)[:, None] & low(right)[None, :])
    i, j = np.nonzero(alike)
    forest, nodes, other = _Forest(), np.array([m[0] for m in left], np.int64), np.array([m[0] for m in right], np.int64)
    forest.add(nodes[i], other[j])
    return forest.a, forest.b


KEY = ["first", "band", "i", "j"]


def _tile_by_tile(rows: DataFrame, key: list[str], work, kinds: str) -> DataFrame:
    """``rows(key..., tile, ...)``, the key KEY or longer, dealt by it; ``work(now, left, right)`` gets the rows of each pair of tiles, ``right`` None where a tile meets itself, and returns columns."""
    columns = [c.split()[0] for c in kinds.split(", ")]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt, tile = rows.repartition(parts, *key).sortWithinPartitions(*key), len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            left, right = (sorted(x, key=lambda m: m[0]) for x in sides)
            own = now[2] == now[3]
            out = work(now, left, None if own else right) if left and (own or right) else [[]] * len(columns)
            return pa.RecordBatch.from_arrays([pa.array(x, KINDS[c.split()[1]]) for x, c in zip(out, kinds.split(", "), strict=True)], columns)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:tile] != now:
                    if now:
                        yield done()
                    now, sides = row[:tile], ([], [])
                sides[row[tile] != now[2]].append(row[tile + 1 :])
        if now:
            yield done()

    return dealt.mapInArrow(run, kinds)


def _compared(firsts: DataFrame, labels: DataFrame | None, docs: DataFrame, marks: DataFrame, width: int, name: str) -> DataFrame:
    """``firsts(first, node, n)`` to edges that connect all alike texts of different labels that share a first shingle."""
    rows = firsts.withColumn("band", F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(1.26))))
    if labels is not None:
        rows = rows.join(labels.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        rows = rows.withColumn("label", F.col("node"))
    mixed = rows.groupBy("first").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("first")
    rows = rows.join(mixed, "first", "left_semi")
    # a text stands in its own band and, marked low, in the next: texts of two low marks meet in their own band
    rows = rows.select("first", "node", "n", "label", F.explode(F.array(F.struct("band", F.lit(False).alias("low")), F.struct((F.col("band") + 1).alias("band"), F.lit(True).alias("low")))).alias("b"))
    rows = rows.select("first", "b.band", "b.low", "node", "n", "label")
    mark = lambda k: F.bit_xor(F.xxhash64("node", "low", F.lit(k)))
    groups = rows.groupBy("first", "band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows"), F.sum("n").alias("shingles"), mark(0).alias("m0"), mark(1).alias("m1"), F.min("low").alias("all_low"))
    groups = groups.where("x <> y AND NOT all_low").groupBy("band", "rows", "m0", "m1").agg(F.min("first").alias("first"), F.max("shingles").alias("shingles"))
    tiles = F.greatest(F.ceil(F.col("shingles") / TILE_SHINGLES), F.ceil(F.col("rows") / TILE_ROWS)).cast("int")
    groups = written(groups.select("first", "band", tiles.alias("tiles")), f"{name}-groups")
    rows = rows.join(groups, ["first", "band"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("i"), F.greatest(k, F.col("tile")).alias("j")))
    rows = rows.select("first", "band", "node", "label", "low", "n", "tile", F.explode(met).alias("t"))
    rows = written(rows.select("first", "band", "t.i", "t.j", "tile", "node", "label", "low", "n"), f"{name}-rows")
    there = marks.join(rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])

    def maybe(now, left, right):
        may = candidates(left, right)
        parts = clusters(may, right is None).tolist()
        members = [(now[2], m) for m in left] + [(now[3], m) for m in right or ()]
        some = may.any(axis=1).tolist() + ([] if right is None else may.any(axis=0).tolist())
        kept = [(part, t, m) for part, (t, m), k in zip(parts, members, some, strict=True) if k]
        return [[x] * len(kept) for x in now] + [[part for part, _, _ in kept], [t for _, t, _ in kept], *([m[k] for _, _, m in kept] for k in range(3))]

    key = [*KEY, "part"]
    rows = _tile_by_tile(rows.join(there, "node").select(*KEY, "tile", "node", "label", "low", "n", "mark"), KEY, maybe, "first long, band long, i int, j int, part int, tile int, node long, label long, low boolean")
    rows = written(rows, f"{name}-partners")
    # the same cluster is found under each first shingle that its texts share; once is enough
    side = lambda k: F.bit_xor(F.xxhash64("node", "low", F.col("tile") == F.col("i"), F.lit(k)))
    found = rows.groupBy(*key).agg(F.count("*").alias("rows"), side(0).alias("m0"), side(1).alias("m1"))
    found = found.groupBy((F.col("i") == F.col("j")).alias("own"), "rows", "m0", "m1").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    rows = written(rows.join(found, key, "left_semi"), f"{name}-clusters")
    touched = written(rows.select("node").distinct(), f"{name}-touched")
    texts = written(docs.join(_small(touched), "node", "left_semi").dropDuplicates(["node"]).select("node", "text"), f"{name}-texts")

    def linked(now, left, right):
        sets = lambda side: side if side is None else [(*m[:3], shingles(m[3], width)) for m in side]
        return tile_links(sets(left), sets(right))

    return written(_tile_by_tile(rows.join(texts, "node").select(*key, "tile", "node", "label", "low", "text"), key, linked, "a long, b long"), f"{name}-links")


def similar_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs(node, text)`` to ``(node, component)`` of the nodes that have a similar one; nodes are hashes of their texts."""
    short_batches(docs.sparkSession)
    prints = written(_prints(docs, width), "shingle-prints")
    edges = _fingerprint_links(prints, docs, width)
    labels = written(connected_components(edges), "shingle-labels")
    firsts = written(_shared_firsts(prints), "shingle-firsts")
    release(docs.sparkSession)
    edges = edges.unionAll(_compared(firsts, labels, docs, _marks(prints), width, "shingle"))
    labels = written(connected_components(edges), "shingle-labels")
    release(docs.sparkSession)
    return labels


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of the least id, of the least text hash where ids repeat.

    Groups are the components of the similar pairs; empty and null texts are one group. A group whose rows all lack an id keeps one.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("row"), _node(F.col("text")).alias("node"))
    labels = similar_groups(keyed.select("node", F.coalesce("row.text", F.lit("")).alias("text")), width)
    # nothing but ids and hashes is shuffled to find the first row of each text, then of each group
    rows = written(keyed.groupBy("node", F.col("row.doc_id").alias("doc_id")).agg(F.count("*").alias("n")), "shingle-ids")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node", "n")
    first = rows.groupBy("node").agg(F.min(order).alias("c")).join(labels, "node", "left")
    chosen = written(first.groupBy(F.coalesce("component", "node").alias("part")).agg(F.min("c").alias("c")).select("c.doc_id", "c.node", "c.n"), "shingle-chosen")
    same = lambda left, doc_id, some: left["node"].eqNullSafe(some["node"]) & left[doc_id].eqNullSafe(some["doc_id"])
    # rows are named by id and text; where several chosen ones have both, one of them is taken
    several = chosen.where("n > 1").select("node", "doc_id")
    once = chosen.where("n = 1")
    gone = _small(written(rows.join(once, same(rows, "doc_id", once), "left_anti").select("node", "doc_id"), "shingle-gone"))
    again = _small(written(several, "shingle-again"))
    kept = keyed.join(gone, same(keyed, "row.doc_id", gone), "left_anti")
    kept = kept.unionAll(keyed.join(again, same(keyed, "row.doc_id", again), "left_semi").dropDuplicates(["node"]))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
