"""Numbers that end in a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even, as 2.675 to 2.67 and 0.125 to 0.12; for 0 <= x <= 100."""
    scale = F.when(x < 1, F.lit(62)).otherwise(F.lit(56))
    whole = (x * F.pow(F.lit(2.0), scale)).cast("long").cast("decimal(38,0)")  # exact: x is a few binary digits longer than its integer part
    unit = F.pow(F.lit(2.0), scale).cast("long").cast("decimal(38,0)")
    many = (whole * F.lit(10**digits)).cast("decimal(38,0)")
    rest = many % unit
    down = F.expr("cast(0 as decimal(38,0))") + (many - rest) / unit
    down = down.cast("decimal(38,0)")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (down % 2 == 1))
    return (down + F.when(up, 1).otherwise(0)).cast("double") / 10**digits


def union(severities: Column) -> Column:
    """Severities joined as chances: 100 * (1 - product of (1 - s)), each clamped to 0..1, nulls skipped."""
    clean = F.filter(severities, lambda s: s.isNotNull())
    one = F.aggregate(clean, F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) - a * F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
    return round_half_even(one * 100, 2)


def max_or(severities: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.array_max(severities), F.lit(default))
