"""Repeated passages from the common-prefix intervals of enhanced suffix arrays.

A passage of ``LENGTH`` bytes holds an anchor: the place where the hash of ``GRAM`` bytes is least. Equal passages have equal
anchors, so suffixes need to be compared only at anchors whose hash occurs in more than one text, and anchors are dealt out
by hash. In a range of hashes the suffixes from the anchors on are sorted, their common prefixes give the interval tree (one
scan with a stack), and every interval is a group of all places that share a prefix. Where the bytes to the left of a group
differ, the group ends a maximal repeat and is split by its left context, which is sorted the same way; where they all agree,
the group goes on to the left and stays whole. Each group knows the smallest document that holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm import chunks as ch
from fieldtrust.llm.common import release, written

LENGTH = 50
GRAM = 19
SPAN = LENGTH - GRAM + 1  # a passage has this many places for its anchor
LEFT, RIGHT = SPAN - 1, LENGTH
BLOCK = 1 << 17
BATCH = 8000
CHUNK_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
NOTHING = hashlib.sha256().hexdigest()


def _grams(b: np.ndarray) -> np.ndarray:
    """Hashes (1 or more) of the GRAM bytes from each place on."""
    h1 = (b.astype(np.uint64) + np.uint64(1)) * ODD[0]
    h2 = h1[:-1] * ODD[1] + h1[1:]
    h = h2
    for width, odd in ((2, ODD[2]), (4, ODD[3]), (8, ODD[4])):
        h = h[:-width] * odd + h[width:]
    n = len(b) - GRAM + 1
    h = (h[:n] * ODD[5] + h2[16 : 16 + n]) * ODD[1] + h1[18 : 18 + n]
    h ^= h >> np.uint64(32)
    h *= ODD[3]
    h ^= h >> np.uint64(29)
    return np.maximum(h, np.uint64(1))


def _slide(x: np.ndarray, pick) -> np.ndarray:
    for width in (1, 2, 4, 8, 16):
        x = pick(x[:-width], x[width:])
    return x


def anchors(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all passages; ``raw`` holds texts of these sizes one after the other."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    places, hashes = [], []
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        lo, hi = starts[at], ends[to - 1]
        if hi - lo >= LENGTH:
            h = _grams(raw[lo:hi])
            least = _slide(h, np.minimum)
            for e in ends[at:to] - lo:  # passages that would run over the end of a text
                least[max(0, e - LENGTH + 1) : e] = 0
            edge = np.zeros(SPAN - 1, np.uint64)
            own = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), np.maximum) == h)
            places.append(own + lo)
            hashes.append(h[own])
        at = to
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _asked(chunks: DataFrame, ranges: int) -> DataFrame:
    """Rows (chunk, range, keys, many): a chunk's distinct anchor hashes, and of each whether two of its texts hold it."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                sizes = np.asarray(r.sizes)
                places, hashes = anchors(np.frombuffer(ch.unsqueeze(r.data), np.uint8), sizes)
                order = np.argsort(hashes, kind="stable")
                h, doc = hashes[order], np.searchsorted(np.cumsum(sizes), places[order], side="right")
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
                last = np.concatenate([first[1:], [len(h)]]) - 1 if len(h) else first
                many = doc[first] != doc[last]
                h = h[first]
                out = [(r.chunk, k, ch.put_sorted(h[a:b]), np.packbits(many[a:b]).tobytes()) for k, a, b in ch.runs(h, ranges)]
                yield pd.DataFrame(out, columns=["chunk", "range", "keys", "many"])

    return chunks.select("chunk", "sizes", "data").mapInPandas(run, "chunk long, range long, keys binary, many binary")


def _copies(chunks: DataFrame) -> DataFrame:
    """Rows (chunk, range -1, payload): the texts of a chunk that equal a text with a smaller id."""
    ids = chunks.select("chunk", F.posexplode("ids").alias("doc", "id"), "digests")
    digest = F.substring("digests", F.col("doc") * 32 + 1, F.lit(32))
    ids = ids.select("chunk", "doc", "id", digest.alias("digest"))
    least = ids.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    least = written(least, "repeat-first-copies")  # a plain table on this side lets Spark split the join where very many texts are equal
    late = ids.join(least, "digest").where("id > least").groupBy("chunk").agg(F.collect_list(F.col("doc").cast("long")).alias("docs"))
    pack = lambda frames: (pd.DataFrame({"chunk": p["chunk"], "range": -1, "payload": [ch.put(np.sort(np.asarray(x, np.int64))) for x in p["docs"]]}) for p in frames)
    return late.mapInPandas(pack, "chunk long, range long, payload binary")


def _split(pdf: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    pdf = pdf.sort_values("range")
    copies = [ch.got(x, np.int64) for x in pdf.loc[pdf["range"] == -1, "payload"]]
    return np.concatenate(copies) if copies else np.empty(0, np.int64), pdf[pdf["range"] >= 0]


def _surroundings(raw: np.ndarray, places: np.ndarray, hashes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A row of bytes for each place: its hash, LEFT bytes before and RIGHT bytes from it on (zero beyond the text), and how many of each lie in the text."""
    k = np.arange(-LEFT, RIGHT)
    padded = np.concatenate([np.zeros(LEFT, np.uint8), raw, np.zeros(RIGHT, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, LEFT + RIGHT)
    out = np.empty((len(places), 8 + LEFT + RIGHT + 2), np.uint8)
    for lo in range(0, len(places), BATCH):  # the index matrices stay small
        s = slice(lo, lo + BATCH)
        inside = (k >= -before[s, None]) & (k < after[s, None])
        out[s, :8] = hashes[s, None].astype(">u8").view(np.uint8)
        out[s, 8:-2] = windows[places[s]] * inside
        out[s, -2], out[s, -1] = before[s], after[s]
    return out


def _contexts(chunks: DataFrame, told: DataFrame, ranges: int) -> DataFrame:
    """What surrounds the shared anchors, each distinct context of a chunk once.

    Rows with a range: the contexts (LEFT bytes before and RIGHT bytes from the anchor on, with how many of each lie in the
    text) and the least and greatest id of the chunk's texts that hold them. The row with range -2: where each occurs.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        copies, answers = _split(right)
        for row in left.itertuples(index=False):
            sizes = np.asarray(row.sizes)
            raw = np.frombuffer(ch.unsqueeze(row.data), np.uint8)
            places, hashes = anchors(raw, sizes)
            distinct, at = np.unique(hashes, return_inverse=True)
            bits = dict(zip(answers["range"], answers["payload"], strict=True))
            shared = np.concatenate([ch.bits(bits[k], b - a) for k, a, b in ch.runs(distinct, ranges)] or [np.empty(0, bool)])
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, places, side="right")
            keep = shared[at] & ~np.isin(doc, copies) if len(at) else np.empty(0, bool)
            places, hashes, doc = places[keep], hashes[keep], doc[keep]
            if not len(places):
                continue
            before, after = np.minimum(LEFT, places - (ends - sizes)[doc]), np.minimum(RIGHT, ends[doc] - places)
            whole = _surroundings(raw, places, hashes, before, after)
            ctx, lens = whole[:, 8:-2], whole[:, -2:]
            _, first, which = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
            ids = np.asarray(row.ids, np.int64)[doc]
            low, high = np.full(len(first), LAST), np.full(len(first), np.iinfo(np.int64).min)
            np.minimum.at(low, which, ids)
            np.maximum.at(high, which, ids)
            for r, a, b in ch.runs(hashes[first], ranges):  # distinct contexts come in the order of their hashes
                f = first[a:b]
                out.append((row.chunk, r, a, ch.squeeze(ctx[f].tobytes()), ch.squeeze(lens[f].tobytes()), ch.put(low[a:b]), ch.put(high[a:b])))
            out.append((row.chunk, -2, 0, ch.put(doc.astype(np.int64)), ch.put(places - (ends - sizes)[doc]), ch.put(which.astype(np.int64)), None))
        return pd.DataFrame(out, columns=["chunk", "range", "first", "a", "b", "c", "d"])

    cols = chunks.select("chunk", "ids", "sizes", "data").groupBy("chunk")
    return cols.cogroup(told.groupBy("chunk")).applyInPandas(run, "chunk long, range long, first long, a binary, b binary, c binary, d binary")


def sorted_suffixes(m: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings in the rows of ``m`` and the common prefix of each with the one before (0 for the first)."""
    by_length = np.argsort(lengths, kind="stable")
    strings = np.ascontiguousarray(m[by_length]).view(f"S{m.shape[1]}").ravel()
    order = by_length[np.argsort(strings, kind="stable")]
    s, n = m[order], lengths[order].astype(np.int64)
    same = s[1:] == s[:-1]
    lcp = np.where(same.all(axis=1), m.shape[1], same.argmin(axis=1))
    return order, np.concatenate([[0], np.minimum(lcp, np.minimum(n[1:], n[:-1]))])


def lcp_intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """The interval tree of a suffix array by one scan with a stack: rows (first, end, prefix length, parent's prefix length), prefixes of ``least`` or more; a parent below that counts as 0."""
    out, starts, depths = [], [0], [0]
    for i, d in enumerate([*lcp[1:].tolist(), 0], 1):
        d = d if d >= least else 0
        start = i - 1
        while depths[-1] > d:
            start, depth = starts.pop(), depths.pop()
            out.append((start, i, depth, max(d, depths[-1])))
        if depths[-1] < d:
            starts.append(start)
            depths.append(d)
    return np.array(out, np.int64).reshape(-1, 4)


def _members(iv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every interval its number and its places in the order, one row each."""
    n = iv[:, 1] - iv[:, 0]
    which = np.repeat(np.arange(len(iv)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + iv[which, 0]


def repeat_groups(ctx: np.ndarray, lens: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts, which passages occur elsewhere: rows (context, first and last number of bytes before the anchor, least id of a text with the passage), by context.

    With ``high``, the greatest id of each context's texts, only rows that concern one of them. Suffixes that share no
    anchor are taken some thousands at a time.
    """
    right, lcp = sorted_suffixes(ctx[:, LEFT:], lens[:, 1])
    high = np.full(len(ctx), LAST) if high is None else high
    cuts = np.append(np.flatnonzero(lcp < GRAM), len(ctx))
    rows, lo = [(np.empty(0, np.int64),) * 4], 0
    while lo < len(ctx):
        k = int(np.searchsorted(cuts, lo + BATCH, side="right")) - 1
        hi = int(cuts[k] if cuts[k] > lo else cuts[k + 1])
        part = right[lo:hi]
        u, a, b, m = _groups_of(ctx[part], lens[part], low[part], np.concatenate([[0], lcp[lo + 1 : hi]]))
        keep = m < high[part[u]]
        rows.append((part[u[keep]], a[keep], b[keep], m[keep]))
        lo = hi
    u, a, b, m = (np.concatenate([r[k] for r in rows]) for k in range(4))
    order = np.argsort(u, kind="stable")
    return u[order], a[order], b[order], m[order]


def _groups_of(ctx: np.ndarray, lens: np.ndarray, low: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for contexts in the order of their right sides, whose common prefixes are ``lcp``."""
    left, left_lcp = sorted_suffixes(ctx[:, LEFT - 1 :: -1], lens[:, 0])
    iv = lcp_intervals(lcp, GRAM)
    # a context stands for all its places in a chunk: it is a group by itself
    before, after = lens[:, 0].astype(np.int64), lens[:, 1].astype(np.int64)
    itself = np.flatnonzero((after >= LENGTH - LEFT) & (before + after >= LENGTH))
    rows = [(itself, np.maximum(0, LENGTH - after[itself]), np.minimum(LEFT, before[itself]), low[itself])]
    rank = np.empty(len(ctx), np.int64)

    def classes(depth: int) -> np.ndarray:
        rank[left] = np.cumsum(left_lcp < depth)
        return rank

    diverse = iv
    if len(iv):
        whole = classes(LEFT)
        which, member = _members(iv)
        heads = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        plain = np.minimum.reduceat(whole[member], heads) == np.maximum.reduceat(whole[member], heads)
        # the same LEFT bytes stand before all of a plain group: it only goes on to the left
        least = np.minimum.reduceat(low[member], heads)
        p = plain[which]
        rows.append((member[p], np.maximum(0, LENGTH - iv[which[p], 2]), np.minimum(LEFT, LENGTH - 1 - iv[which[p], 3]), least[which[p]]))
        diverse = iv[~plain]
    for o in range(SPAN):
        some = diverse[(diverse[:, 3] < LENGTH - o) & (diverse[:, 2] >= LENGTH - o)]
        if not len(some):
            continue
        which, member = _members(some)
        inside = lens[member, 0] >= o
        which, member = which[inside], member[inside]
        if not len(member):
            continue
        _, code, n = np.unique(which * (len(ctx) + 1) + classes(o)[member], return_inverse=True, return_counts=True)
        first = np.full(len(n), LAST)
        np.minimum.at(first, code, low[member])
        rows.append((member, np.full(len(member), o), np.full(len(member), o), first[code]))
    u, a, b, m = (np.concatenate([r[k] for r in rows]) for k in range(4))
    if not len(u):
        return u, a, b, m
    order = np.lexsort((a, m, u))
    u, a, b, m = u[order], a[order], b[order], m[order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (m[1:] != m[:-1]) | (a[1:] > b[:-1] + 1)])
    starts = np.flatnonzero(new)
    return u[starts], a[starts], np.maximum.reduceat(b, starts), m[starts]


def _groups(contexts: DataFrame) -> DataFrame:
    """Rows (chunk, range, payload): for the contexts of a chunk the passages that a text with a smaller id holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        ctx = np.concatenate([np.frombuffer(ch.unsqueeze(x), np.uint8).reshape(-1, LEFT + RIGHT) for x in pdf["a"]])
        lens = np.concatenate([np.frombuffer(ch.unsqueeze(x), np.uint8).reshape(-1, 2) for x in pdf["b"]])
        low, high = (np.concatenate([ch.got(x, np.int64) for x in pdf[c]]) for c in ("c", "d"))
        u, a, b, m = repeat_groups(ctx, lens, low, high)
        sizes = np.array([len(ch.got(x, np.int64)) for x in pdf["c"]])
        ends = np.cumsum(sizes)
        edges = np.concatenate([[0], np.searchsorted(u, ends)])
        out = []
        for k, (c, r, first) in enumerate(zip(pdf["chunk"], pdf["range"], pdf["first"], strict=True)):
            s = slice(edges[k], edges[k + 1])
            if s.stop > s.start:
                out.append((c, r, ch.put(np.concatenate([u[s] - (ends[k] - sizes[k]) + first, a[s], b[s], m[s]]).astype(np.int64))))
        return pd.DataFrame(out, columns=["chunk", "range", "payload"])

    return contexts.where("range >= 0").groupBy("range").applyInPandas(run, "chunk long, range long, payload binary")


def _spans(occ: pd.DataFrame, answers: pd.DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the passages to remove in a chunk."""
    doc, place, which = (np.concatenate([ch.got(x, np.int64) for x in occ[c]]) for c in ("a", "b", "c"))
    runs = np.concatenate([ch.got(x, np.int64).reshape(4, -1) for x in answers["payload"]], axis=1)
    runs = runs[:, np.argsort(runs[0], kind="stable")]
    lo, hi = np.searchsorted(runs[0], which), np.searchsorted(runs[0], which, side="right")
    who, at = _members(np.stack([lo, hi], axis=1))
    keep = runs[3, at] < ids[doc[who]]
    who, at = who[keep], at[keep]
    return doc[who], place[who] - runs[2, at], place[who] - runs[1, at] + LENGTH


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` and, with ``texts``, the ``kept`` bytes.

    Removed is each byte in a run of 50 that also starts in a text with a smaller id; matches stay within texts and are
    judged on the input. Null texts are empty; texts under 50 bytes lose nothing; a null id counts as the greatest, 2^63 - 1. Rows
    that repeat an id take nothing from each other. A passage that very many texts hold leaves each chunk once.
    """
    packed = ch.pack(docs, "repeat-chunks", CHUNK_BYTES)
    ranges = ch.ranges_for(packed, 3)
    spark: SparkSession = docs.sparkSession
    copies = written(_copies(packed), "repeat-copies")
    told = written(ch.held_by_several(_asked(packed, ranges)), "repeat-shared").unionAll(copies)
    release(spark)
    found = written(_contexts(packed, told, ranges), "repeat-contexts")
    release(spark)
    groups = written(_groups(found), "repeat-groups")
    release(spark)
    none = F.lit(None).cast("binary")
    last = groups.unionAll(copies).select("chunk", "range", "payload", none.alias("a"), none.alias("b"), none.alias("c"))
    last = last.unionAll(found.where("range = -2").select("chunk", "range", none, "a", "b", "c"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples(index=False):
            sizes, raw = np.asarray(row.sizes), ch.unsqueeze(row.data)
            copied, answers = _split(right)
            ids = np.asarray(row.ids, np.int64)
            occ = right[right["range"] == -2]
            if len(occ) and len(answers):
                doc, start, end = _spans(occ, answers, ids)
                order = np.argsort(doc, kind="stable")
                doc, start, end = doc[order], start[order], end[order]
            else:
                doc = start = end = np.empty(0, np.int64)
            edges = np.searchsorted(doc, np.arange(len(sizes) + 1))
            copied, at = set(copied.tolist()), 0
            for i, n in enumerate(sizes.tolist()):
                text = raw[at : at + n]
                at += n
                a, b = edges[i], edges[i + 1]
                if i in copied and n >= LENGTH:
                    gone, spans, sha, kept = n, 1, NOTHING, b""
                elif b > a:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, start[a:b], 1)
                    np.add.at(step, end[a:b], -1)
                    cover = np.cumsum(step[:-1]) > 0
                    kept = np.frombuffer(text, np.uint8)[~cover].tobytes()
                    gone, spans = n - len(kept), int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                    sha = hashlib.sha256(kept).hexdigest()
                else:
                    gone, spans, sha, kept = 0, 0, row.digests[32 * i : 32 * i + 32].hex(), text
                out.append((int(ids[i]) if row.known[i] else None, n, gone, spans, sha, *([kept] if texts else [])))
        frame = pd.DataFrame([r[1:] for r in out], columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])
        frame.insert(0, "doc_id", pd.array([r[0] for r in out], "Int64"))  # by itself: beside a None pandas makes doubles of ids
        return frame

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return packed.select("chunk", "ids", "known", "sizes", "digests", "data").groupBy("chunk").cogroup(last.groupBy("chunk")).applyInPandas(run, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
