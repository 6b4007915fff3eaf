"""Expectations as reports: violation counts per recording, or for a whole table in the pass that writes it."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Expectations as conditions that break them, by name.
WORD_RULES: Mapping[str, Column | str] = {
    "untimed": "start_ms IS NULL OR end_ms IS NULL",
    "bad_confidence": "confidence NOT BETWEEN 0 AND 1",
    "backwards": "end_ms < start_ms",
}
JOB_RULES: Mapping[str, Column | str] = {
    "bad_status": "status NOT IN ('queued', 'processing', 'complete', 'failed')",
    "bad_progress": "progress NOT BETWEEN 0 AND 1",
    "ended_before_start": "completed_at < started_at",
}


class Watched:
    """A table whose rows are counted against rules while another job reads them: no pass of its own.

    Take ``rows`` in place of the table; once an action over all of them is done, ``counts()`` has the number of rows and of
    violations of each rule. An unfinished action has no counts, and ``counts`` waits for one.
    """

    def __init__(self, rows: DataFrame, rules: Mapping[str, Column | str], name: str = "quality"):
        self._seen = Observation(name)
        broken = {n: F.expr(r) if isinstance(r, str) else r for n, r in rules.items()}
        self.rows = rows.observe(self._seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in broken.items()])

    def counts(self) -> dict[str, Any]:
        return self._seen.get


def word_checks(words: DataFrame, recordings: DataFrame) -> DataFrame:
    """Words without times, confidences outside [0, 1], and recordings without words."""
    confidence = F.col("confidence")
    counted = words.groupBy("recording_id").agg(
        F.count("*").alias("n_words"),
        F.count_if(F.col("start_ms").isNull() | F.col("end_ms").isNull()).alias("untimed"),
        F.count_if(~F.coalesce(confidence.between(0, 1), F.lit(True))).alias("bad_confidence"),
    )
    zero = F.lit(0)
    return recordings.join(counted, ["recording_id"], "left").select(
        "recording_id",
        *[F.coalesce(c, zero).alias(c) for c in ("n_words", "untimed", "bad_confidence")],
        F.coalesce(F.col("n_words") > 0, F.lit(False)).alias("has_words"),
    )


def stylization_checks(styled: DataFrame) -> DataFrame:
    """Per recording: segments whose contour changed length or whose cost is negative."""
    return styled.groupBy("recording_id").agg(
        F.count("*").alias("n_segments"),
        F.count_if(F.size("stylized") != F.size("x")).alias("bad_length"),
        F.count_if(F.col("cost") < 0).alias("negative_cost"),
    )


def word_pitch_checks(features: DataFrame, n_chars) -> DataFrame:
    """Per recording: voiced words whose character values differ from their letters; unvoiced words with values."""
    voiced = F.col("mean_pitch").isNotNull()
    return features.groupBy("recording_id").agg(
        F.count("*").alias("n_words"),
        F.count_if(voiced).alias("n_voiced"),
        F.count_if(voiced & (F.size("char_pitches") != n_chars)).alias("bad_chars"),
        F.count_if(~voiced & F.col("char_pitches").isNotNull()).alias("unvoiced_with_values"),
    )


def tone_check(frames: DataFrame, low: float = 180.0, high: float = 220.0) -> DataFrame:
    """Mean tracked pitch per recording and whether it lies within the bounds of a known tone."""
    return frames.groupBy("recording_id").agg(F.avg("f0").alias("mean_f0")).withColumn(
        "within", F.coalesce(F.col("mean_f0").between(low, high), F.lit(False))
    )


def state_checks(state: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Job rows outside the closed status set or with progress outside [0, 1]."""
    return state.agg(
        F.count("*").alias("n_jobs"),
        F.count_if(~F.col("status").isin(*statuses)).alias("bad_status"),
        F.count_if(~F.col("progress").between(0, 1)).alias("bad_progress"),
    )
