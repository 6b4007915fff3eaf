"""Recogniser output to words and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.functions.timing import to_ms
from lilt.functions.tokens import strip_space
from lilt.operators.scan import Run, running, text_pieces

# Fixed value: segments above this are treated as silence.
NO_SPEECH = 0.85


def drop_no_speech(segments: DataFrame, limit: float = NO_SPEECH) -> DataFrame:
    return segments.filter(F.coalesce(F.col("no_speech_prob") <= limit, F.lit(True)))


def explode_words(segments: DataFrame) -> DataFrame:
    """One row per recognised word, stripped, in milliseconds, confidence to three places; ``word_idx`` is dense."""
    kept = drop_no_speech(segments).withColumn("_n", F.coalesce(F.size("words"), F.lit(0)).cast("bigint"))
    based = running(
        kept, ["recording_id"], "seg_idx", {"_base": Run("sum", F.greatest(F.col("_n"), F.lit(0)), inclusive=False)},
        blocks=[F.expr("seg_idx div 4096")],
    )
    return based.select("recording_id", "seg_idx", "_base", F.posexplode("words").alias("p", "w")).select(
        "recording_id",
        (F.col("_base") + F.col("p")).alias("word_idx"),
        "seg_idx",
        strip_space(F.col("w.word")).alias("word"),
        to_ms(F.col("w.start_s")).alias("start_ms"),
        to_ms(F.col("w.end_s")).alias("end_ms"),
        F.round("w.probability", 3).alias("confidence"),
    )


def segment_text(segments: DataFrame) -> DataFrame:
    """Full text per recording as pieces: the text of each kept segment, its character ``offset`` in the text that joins
    them with one blank, and the ``total_chars`` of that text."""
    kept = drop_no_speech(segments).select("recording_id", "seg_idx", strip_space(F.col("text")).alias("text"))
    return text_pieces(kept, ["recording_id"], "seg_idx", [F.expr("seg_idx div 4096")])
