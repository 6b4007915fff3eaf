"""Scalar pitch rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative change below which a word is flat, and the absolute one of the intonation rule.
TREND_RATIO = 0.03
DIRECTION_HZ = 15.0
FLAT, RISING, FALLING = "→", "↑", "↓"


def voiced(f0: Column) -> Column:
    return F.coalesce(f0 > 0, F.lit(False))


def voiced_or_null(f0: Column) -> Column:
    """Zero and NaN mark unvoiced frames on input; inside they are NULL."""
    return F.when((F.nanvl(f0, F.lit(0.0)) > 0), f0)


def pitch_trend(start: Column, end: Column, mean: Column) -> Column:
    change = end - start
    return (
        F.when(mean.isNull(), F.lit(None))
        .when((mean <= 0) | (F.abs(change) < mean * TREND_RATIO), FLAT)
        .when(change > 0, RISING)
        .otherwise(FALLING)
    )


def pitch_direction(start: Column, end: Column, voiced_frames: Column) -> Column:
    delta = end - start
    return (
        F.when(F.coalesce(voiced_frames, F.lit(0)) < 2, "unvoiced")
        .when(delta > DIRECTION_HZ, "rising")
        .when(delta < -DIRECTION_HZ, "falling")
        .otherwise("flat")
    )


def normalize_pitch(value: Column, low: Column, high: Column) -> Column:
    """Position within the range of the recording; 0.5 for an empty range."""
    return F.when(value.isNull(), F.lit(None)).when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.5))


def octave_log_ratio(estimate: Column, reference: Column) -> Column:
    return F.when((estimate > 0) & (reference > 0), F.log2(estimate / reference))
