"""Rows within a radius counted in tasks: cubes hold their rows and those that the radius reaches, and cells of a cube are halved.

A pair of cells wholly within the radius adds its count, one wholly outside goes, one with few places is compared place by place
and the rest is halved, all with arrays. So a crowd in a cube costs its cells, not its pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions import geo
from fieldtrust.operators import slices

#: A cube is so many radii wide; the finest cells are so many halvings under the radius.
SIDE, DEPTH = 128, 12
#: Pairs of cells with so many pairs of places, at most, are compared; pairs of places and pairs of cells of one step; a cell with so many pairs to compare does so by a product of matrices.
PAIRED, STEP, CELLS, DENSE = 1 << 16, 1 << 18, 1 << 13, 4096


def chord(radius_m: float) -> float:
    """The straight way, on an earth of radius 1."""
    return 2 * math.sin(min(radius_m / (2 * geo.EARTH_KM * 1000), math.pi / 2))


def edge(radius_m: float) -> float:
    return max(SIDE * chord(radius_m), 2.0**-18)


def with_cubes(rows: DataFrame, radius_m: float) -> DataFrame:
    """Adds ``home`` to rows with ``la`` and ``lo``, the number of the cube around the earth's centre that the place lies in (so poles and the date line are no borders), and ``touched``, those of all that its radius touches."""
    reach, wide, names = chord(radius_m) * (1 + 1e-6) + 1e-14, edge(radius_m), rows.columns
    lat, lon = F.radians("la"), F.radians("lo")
    number = lambda c: (F.col(c[0]) * (1 << 20) + F.col(c[1])) * (1 << 20) + F.col(c[2])
    # step by step, as a sine that is named in several places is worked out as often
    d = rows.select("*", (F.cos(lat) * F.cos(lon) + 2).alias("_x"), (F.cos(lat) * F.sin(lon) + 2).alias("_y"), (F.sin(lat) + 2).alias("_z"))
    d = d.select(*names, *[F.floor((F.col(f"_{k}") + by) / wide).alias(f"_{k}{n}") for k in "xyz" for n, by in enumerate((-reach, 0.0, reach))])
    d = d.select("*", *[number([f"_{k}{n}" for k in "xyz"]).alias(c) for n, c in enumerate(("_low", "home", "_high"))])
    several = F.array_distinct(F.array(*[number(c) for c in itertools.product(*[(f"_{k}0", f"_{k}2") for k in "xyz"])]))
    return d.select(*names, "home", F.when(F.col("_low") == F.col("_high"), F.array("home")).otherwise(several).alias("touched"))


def units(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _interleaved(q: np.ndarray) -> np.ndarray:
    """The bits of three whole numbers under 2^20 by turns, so that cells of every size are runs of the order."""
    q = q.astype(np.int64)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        q = (q | (q << shift)) & mask
    return (q[:, 0] << 2) | (q[:, 1] << 1) | q[:, 2]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def counted(group: np.ndarray, cube: np.ndarray, la: np.ndarray, lo: np.ndarray, asks: np.ndarray, counts: np.ndarray, radius_m: float, wide: float) -> np.ndarray:
    """How many of the rows that count lie within the radius of each row that asks (0 of the others) and are of its group. A group lies in one cube, of the edge ``wide``."""
    if not len(group) or not asks.any():
        return np.zeros(len(group), np.int64)
    c = chord(radius_m)
    per_axis = math.ceil(wide / c) + 6
    bits = per_axis.bit_length()
    depth = max(0, min(DEPTH, 20 - bits))
    u = units(la, lo)
    corner = np.stack([cube >> 40, (cube >> 20) & ((1 << 20) - 1), cube & ((1 << 20) - 1)], axis=1)
    q = np.clip(np.floor((u + 2 - corner * wide) * ((1 << depth) / c)).astype(np.int64) + (2 << depth), 0, (1 << (bits + depth)) - 1)
    code = _interleaved(q)
    # equal places are one
    order = np.lexsort((lo, la, code, group))
    first = _changes(group[order], la[order], lo[order])
    place = np.empty(len(group), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
    w, asked = np.add.reduceat(counts[order].astype(np.int64), first), np.add.reduceat(asks[order].astype(np.int64), first) > 0
    at = order[first]
    la, lo, u, q, code, group = la[at], lo[at], u[at], q[at], code[at], group[at]
    rank = np.zeros(len(at), np.int64)
    rank[_changes(group)[1:]] = 1
    rank = np.cumsum(rank)
    sums, asking = np.append(0, np.cumsum(w)), np.append(0, np.cumsum(asked))

    tables: list[tuple] = []

    def cells(level: int) -> tuple:
        """Of the cells of a level where they begin and end, where they lie, the rows that count and the places that ask."""
        while len(tables) <= level:
            up = depth - len(tables)
            begin = _changes(rank, code >> (3 * up))
            end = np.append(begin[1:], len(at))
            tables.append((begin, end, q[begin] >> up, sums[end] - sums[begin], asking[end] - asking[begin]))
        return tables[level]

    n, steps = np.zeros(len(at), np.int64), np.zeros(len(at) + 1, np.int64)  # steps are summed up in the end
    slack, blur = 1e-6 + 1e-14 / c, 1e-9 + 1e-14 / c

    def compare(begin: np.ndarray, end: np.ndarray, other: np.ndarray, until: np.ndarray) -> None:
        o = np.argsort(begin, kind="stable")
        begin, end, other, until = begin[o], end[o], other[o], until[o]
        first = _changes(begin, end)
        held = np.add.reduceat(until - other, first) if len(first) else first
        dense = (end[first] - begin[first]) * held >= DENSE
        last = np.append(first[1:], len(begin))
        for f, l in zip(first[dense].tolist(), last[dense].tolist(), strict=True):
            block(int(begin[f]), int(end[f]), slices.ragged(other[f:l], until[f:l] - other[f:l]))
        rest = np.repeat(~dense, last - first)
        begin, end, other, until = begin[rest], end[rest], other[rest], until[rest]
        size = end - begin
        a, b, many = slices.ragged(begin, size), np.repeat(other, size), np.repeat(until - other, size)
        mine = asked[a]
        a, b, many = a[mine], b[mine], many[mine]
        part = np.cumsum(many) // STEP
        for one in np.split(np.arange(len(a)), _changes(part)[1:]):
            i, j = np.repeat(a[one], many[one]), slices.ragged(b[one], many[one])
            some = w[j] > 0
            i, j = i[some], j[some]
            far = ((u[i] - u[j]) ** 2).sum(axis=1)
            near = far <= c * c * (1 - blur)
            rim = np.flatnonzero(~near & (far <= c * c * (1 + blur)))
            near[rim] = metres(la[i[rim]], lo[i[rim]], la[j[rim]], lo[j[rim]]) <= radius_m
            np.add.at(n, i[near], w[j[near]])

    def block(begin: int, end: int, j: np.ndarray) -> None:
        """A cell against all places of its near cells, as a product of matrices."""
        i, j = begin + np.flatnonzero(asked[begin:end]), j[w[j] > 0]
        if not len(i) or not len(j):
            return
        x, y, weights = u[i] - u[begin], u[j] - u[begin], w[j]  # from a place nearby, so that nothing is lost to the globe's size
        xx, yy, one = (x**2).sum(axis=1), (y**2).sum(axis=1), bool((weights == 1).all())
        for s in range(0, len(i), max(1, STEP // len(j))):
            e = s + max(1, STEP // len(j))
            far = xx[s:e, None] + yy - 2 * (x[s:e] @ y.T)
            near = far <= c * c * (1 - blur)
            n[i[s:e]] += np.count_nonzero(near, axis=1) if one else near @ weights
            p, q = np.nonzero(~near & (far <= c * c * (1 + blur)))
            close = metres(la[i[s + p]], lo[i[s + p]], la[j[q]], lo[j[q]]) <= radius_m
            np.add.at(n, i[s + p[close]], weights[q[close]])

    begin, end, where, sent, askers = cells(0)
    run = (rank[begin] << (3 * bits)) | _interleaved(where)
    from_ = np.flatnonzero(askers)
    todo: list[tuple[int, np.ndarray, np.ndarray]] = []

    def put(level: int, i: np.ndarray, j: np.ndarray) -> None:
        todo.extend((level, i[s : s + CELLS], j[s : s + CELLS]) for s in range(0, len(i), CELLS))

    for d in itertools.product((-1, 0, 1), repeat=3):
        wanted = (rank[begin[from_]] << (3 * bits)) | _interleaved(np.maximum(where[from_] + d, 0))
        found = np.minimum(np.searchsorted(run, wanted), len(run) - 1)
        hit = (run[found] == wanted) & (sent[found] > 0)
        put(0, from_[hit], found[hit])
    while todo:
        level, i, j = todo.pop()
        begin, end, where, sent, _ = cells(level)
        gap = np.abs(where[i] - where[j])
        unit = float(4**level)
        whole = ((gap + 1) ** 2).sum(axis=1) < unit * (1 - slack)
        open_ = ~whole & ((np.maximum(gap - 1, 0) ** 2).sum(axis=1) <= unit * (1 + slack))
        np.add.at(steps, begin[i[whole]], sent[j[whole]])
        np.subtract.at(steps, end[i[whole]], sent[j[whole]])
        i, j = i[open_], j[open_]
        few = ((end[i] - begin[i]) * (end[j] - begin[j]) <= PAIRED) | (level == depth)
        if few.any():
            compare(begin[i[few]], end[i[few]], begin[j[few]], end[j[few]])
        i, j = i[~few], j[~few]
        if len(i):
            below, _, _, sent_below, askers_below = cells(level + 1)
            a, a_end = np.searchsorted(below, begin[i]), np.searchsorted(below, end[i])
            b, b_end = np.searchsorted(below, begin[j]), np.searchsorted(below, end[j])
            i = slices.ragged(a, a_end - a)
            b, size = np.repeat(b, a_end - a), np.repeat(b_end - b, a_end - a)
            mine = askers_below[i] > 0
            i, b, size = i[mine], b[mine], size[mine]
            i, j = np.repeat(i, size), slices.ragged(b, size)
            put(level + 1, i[sent_below[j] > 0], j[sent_below[j] > 0])
    n += np.cumsum(steps[:-1])
    return np.where(asks, n[place], 0)


def metres(la: np.ndarray, lo: np.ndarray, lb: np.ndarray, lp: np.ndarray) -> np.ndarray:
    """``geo.haversine_m`` on arrays, with the same steps."""
    h = np.sin(np.radians(lb - la) / 2) ** 2 + np.cos(np.radians(la)) * np.cos(np.radians(lb)) * np.sin(np.radians(lp - lo) / 2) ** 2
    return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0))) * 1000


def in_cubes(batches: Iterator[pa.RecordBatch], radius_m: float, wide: float, both: bool) -> Iterator[pa.RecordBatch]:
    """``(choice, value, id, g, la, lo, role)``, sorted by choice and value, to ``(id, la, lo, n, same)`` of the rows that ask (role 1 or 3): the rows that count (2 or 3) of their choice and cube, and those of their ``g`` as well."""
    for t in slices.whole_keys(batches):
        value, la, lo, role = (t.column(c).to_numpy() for c in ("value", "la", "lo", "role"))
        ends = slices.key_ends(t)
        group = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        asks, counts = (role & 1) > 0, (role & 2) > 0
        n, same = counted(group, value, la, lo, asks, counts, radius_m, wide), np.zeros(len(group), np.int64)
        if both:
            kinds = t.column("g").combine_chunks().dictionary_encode()
            known = np.flatnonzero(kinds.indices.is_valid().to_numpy(zero_copy_only=False))
            kind = kinds.indices.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
            same[known] = counted(group[known] * max(1, len(kinds.dictionary)) + kind, value[known], la[known], lo[known], asks[known], counts[known], radius_m, wide)
        mine = np.flatnonzero(asks)
        ids = t.column("id").combine_chunks().take(pa.array(mine))
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(x[mine]) for x in (la, lo, n, same)]], ["id", "la", "lo", "n", "same"])
