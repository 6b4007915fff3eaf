"""Array expressions over pitch contours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Deepest Haar level and largest number of pieces.
HAAR_LEVEL = 3
MAX_PIECES = 8


def resample_linear(values: str, points: str) -> Column:
    """``points`` values at equal steps from the first to the last value of the array column ``values``.

    One point takes the first value.
    """
    step = f"(i * (size({values}) - 1) / greatest({points} - 1, 1))"
    low, high = f"cast(floor({step}) as int)", f"cast(ceil({step}) as int)"
    return F.expr(
        f"CASE WHEN size({values}) > 0 AND {points} > 0 THEN transform(sequence(0, {points} - 1), i -> "
        f"{values}[{low}] + ({values}[{high}] - {values}[{low}]) * ({step} - floor({step}))) END"
    )


def display_resample(values: str, points: str) -> Column:
    """As ``resample_linear``, but a single point takes the middle of the contour."""
    at = f"(CASE WHEN {points} > 1 THEN i / ({points} - 1) ELSE 0.5D END * (size({values}) - 1))"
    low = f"cast(floor({at}) as int)"
    high = f"least(cast(ceil({at}) as int), size({values}) - 1)"
    part = f"({at} - floor({at}))"
    return F.expr(
        f"CASE WHEN size({values}) > 0 AND {points} > 0 THEN transform(sequence(0, {points} - 1), i -> "
        f"{values}[{low}] * (1 - {part}) + {values}[{high}] * {part}) END"
    )


def _pairs(values: Column, combine) -> Column:
    """Combine neighbours two by two; an odd last value is paired with itself."""
    even = F.filter(values, lambda _, i: i % 2 == 0)
    odd = F.filter(values, lambda _, i: i % 2 == 1)
    return F.zip_with(even, odd, lambda a, b: combine(a, F.coalesce(b, a)))


def _extrema(values: Column) -> Column:
    """Number of strict interior maxima and minima."""
    n = F.size(values)
    turn = F.zip_with(
        F.slice(values, 2, n - 1), F.slice(values, F.lit(1), n - 1), lambda b, a: F.signum(b - a)
    )
    crossed = F.zip_with(turn, F.slice(turn, 2, F.greatest(n - 2, F.lit(0))), lambda p, q: p * q)
    return F.size(F.filter(crossed, lambda c: c == -1))


def piece_count(x: Column) -> Column:
    """Pieces for a segment: one more than the extrema of its Haar detail at level 3, at most 8.

    The scale factors of the transform are left out, as they do not move extrema.
    """
    add, diff = (lambda a, b: a + b), (lambda a, b: a - b)
    once = _pairs(x, add)
    twice = _pairs(once, add)

    def count(detail):
        return F.when(F.size(detail) < 3, 1).otherwise(F.least(F.lit(MAX_PIECES), _extrema(detail) + 1))

    n = F.size(x)
    return (
        F.when(n >= 8, count(_pairs(twice, diff)))
        .when(n >= 4, count(_pairs(once, diff)))
        .when(n >= 2, count(_pairs(x, diff)))
        .otherwise(1)
    )
