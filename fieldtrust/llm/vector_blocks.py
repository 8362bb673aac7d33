"""Blocks of vectors: each Arrow batch of rows becomes one row that carries its vectors, scaled to whole numbers, in few bytes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True where the vector is not null and no component is null, NaN or infinite; never null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def limit(width: int) -> int:
    """The largest magnitude for which the squared distance of two vectors of ``width`` whole numbers fits a long."""
    return math.isqrt((2**63 - 1) // max(1, width)) // 2


def whole(values: np.ndarray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of doubles as longs; magnitudes beyond ``limit(width)``, whose distances no long holds, are held there."""
    top = limit(width)
    return np.clip(np.floor(values * float(scale)), -top, top).astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column whose lists all have ``width`` components as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def pack(x: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers in the fewest bytes a number (1, 2, 4 or 8), and that number."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s - 1))
    return x.astype(f"<i{size}").tobytes(), size


def unpack(raw: bytes, size: int, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{size}").reshape(shape).astype(np.int64)


def first_vectors(vectors: DataFrame, order: list[Column], count: int, scale: int, width: int) -> np.ndarray:
    """The vectors of the first ``count`` rows as whole numbers; rows that tie in ``order`` follow their vectors."""
    rows = vectors.orderBy(*order, "embedding").limit(count).select("embedding").collect()  # count rows
    return whole(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), width), scale, width)


def floor_means(old: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """floor(sum / count), all floors downwards; entries without a row stay."""
    return np.where((counts > 0)[..., None], sums // np.maximum(counts, 1)[..., None], old)


def summed(partials: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """``partials(k, s)`` added up by ``k``, the place in an array of ``shape``: so many rows reach the driver, whatever the input."""
    out = np.zeros(shape, np.int64)
    for r in partials.groupBy("k").agg(F.sum("s").alias("s")).collect():
        out.flat[r.k] = r.s
    return out


def partial_rows(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["k", "s"])
