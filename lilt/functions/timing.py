"""Pauses, confidence bands and time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def to_ms(seconds_col: Column) -> Column:
    return F.round(seconds_col * 1000).cast("bigint")


def offset_ms(ms: Column, offset: Column) -> Column:
    return ms + offset


def frame_time_ms(frame_idx: Column, hop_ms: Column) -> Column:
    return frame_idx * hop_ms


def pause_class(word: Column, pause_ms: Column, last: Column) -> Column:
    """none, comma, medium or long; the last word of a phrase never shows a pause."""
    marked = word.rlike("[.,!?;:]$")
    return (
        F.when(last, "none")
        .when(pause_ms > 1000, "long")
        .when(pause_ms > 500, "medium")
        .when((pause_ms >= 200) & ~marked, "comma")
        .otherwise("none")
    )


def confidence_band(confidence: Column) -> Column:
    sure = F.coalesce(confidence, F.lit(1.0))
    return F.when(sure < 0.85, "blurred").when(sure < 0.95, "dim").otherwise("clear")
