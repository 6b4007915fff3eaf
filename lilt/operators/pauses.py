"""Hesitation absorption and confidence over the words that remain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.operators.scan import Run, running

REC = ["recording_id"]


def absorb_hesitations(words: DataFrame) -> DataFrame:
    """Remove hesitations after the first kept word of a phrase; their duration and pause extend the pause of the
    kept word before them. A hesitation that opens a phrase is kept.

    All words of one run share the index of their anchor, so a plain aggregation (with its map-side part) does it.
    """
    anchor = (F.col("pos") == 0) | ~F.col("is_hesitation")
    spoken = running(words, REC, "word_idx", {"_anchor": Run("max", F.when(anchor, F.col("word_idx")))})
    own = F.col("word_idx") == F.col("_anchor")
    kept = F.when(own, F.struct("phrase_index", "pos", "word", "start_ms", "end_ms", "confidence", "is_hesitation"))
    extra = F.col("pause_after_ms") + F.when(own, F.lit(0)).otherwise(F.col("end_ms") - F.col("start_ms"))
    return (
        spoken.groupBy("recording_id", F.col("_anchor").alias("word_idx"))
        .agg(F.max(kept).alias("k"), F.sum(extra).alias("pause_after_ms"), (F.count("*") - 1).alias("absorbed"))
        .select("recording_id", "word_idx", "k.*", "pause_after_ms", "absorbed")
    )


def average_confidence(absorbed: DataFrame) -> DataFrame:
    """Rounded mean confidence in percent per recording; a missing confidence counts as 1."""
    return absorbed.groupBy("recording_id").agg(
        F.round(F.avg(F.coalesce("confidence", F.lit(1.0))) * 100).cast("bigint").alias("avg_confidence_pct")
    )
