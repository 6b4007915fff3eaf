"""Session rollups, partial results, word reports and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lilt.functions.timing import confidence_band, pause_class, seconds
from lilt.operators.phrases import PIECE_WORDS
from lilt.operators.scan import Run, attach, block_of, running
from lilt.session import cut

REC = ["recording_id"]


def words_per_minute(n: Column, duration_ms: Column) -> Column:
    """A duration of zero or less counts as one minute."""
    return F.when(duration_ms > 0, n / (duration_ms / F.lit(60000.0))).otherwise(n.cast("double"))


def session_summary(words: DataFrame, recordings: DataFrame, with_pauses: bool = False) -> DataFrame:
    """One row per recording, also for those without words.

    ``words(recording_id, stressed[, pitch_mean])``. Hesitations count as words. Pitch variation is the population
    standard deviation of the word means, 0.0 with fewer than two. ``with_pauses`` adds pause time, long pauses and
    hesitations in the same aggregation.
    """
    pitch = F.col("pitch_mean") if "pitch_mean" in words.columns else F.lit(None).cast("double")
    counted = words.withColumn("_p", pitch).groupBy("recording_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("stressed").cast("bigint")).alias("s"),
        F.count("_p").alias("np"),
        F.stddev_pop("_p").alias("sd"),
        *(
            [
                F.sum("pause_after_ms").alias("pause_ms"),
                F.count_if(F.col("pause_after_ms") > 500).alias("long_pauses"),
                F.count_if("is_hesitation").alias("hesitations"),
            ]
            if with_pauses
            else []
        ),
    )
    n = F.coalesce("n", F.lit(0))
    return recordings.join(counted, REC, "left").select(
        "recording_id",
        seconds(F.col("duration_ms")).alias("total_duration"),
        n.alias("word_count"),
        words_per_minute(n, F.col("duration_ms")).alias("wpm"),
        F.when(n > 0, F.col("s") / n).otherwise(F.lit(0.0)).alias("stress_ratio"),
        F.when(F.col("np") >= 2, F.round("sd", 1)).otherwise(F.lit(0.0)).alias("pitch_variation"),
        *([F.coalesce(c, F.lit(0)).alias(c) for c in ("pause_ms", "long_pauses", "hesitations")] if with_pauses else []),
    )


def partial_results(words: DataFrame, recordings: DataFrame) -> DataFrame:
    """Summary over phrases 0..k after each phrase, with progress and stage; speed divides by the full duration."""
    phrases = cut(
        words.groupBy("recording_id", "phrase_index").agg(
            F.count("*").alias("n"), F.sum(F.col("stressed").cast("bigint")).alias("s")
        ),
        "phrases",
    )
    totals = phrases.groupBy("recording_id").agg((F.max("phrase_index") + 1).alias("n_phrases")).join(
        recordings.select("recording_id", "duration_ms"), REC
    )
    cumulated = running(
        phrases, REC, "phrase_index", {"word_count": Run("sum", F.col("n")), "_s": Run("sum", F.col("s"))}
    )
    done = F.col("phrase_index") + 1
    return attach(cumulated, totals, REC, block_of("phrase_index")).select(
        "recording_id",
        "phrase_index",
        "word_count",
        words_per_minute(F.col("word_count"), F.col("duration_ms")).alias("wpm"),
        (F.col("_s") / F.col("word_count")).alias("stress_ratio"),
        (F.lit(0.20) + F.lit(0.55) * done / F.greatest(F.lit(1), F.col("n_phrases"))).alias("progress"),
        done.alias("completed_chunks"),
        F.concat_ws("_", F.lit("analyzing_sentence"), done, F.lit("of"), F.col("n_phrases")).alias("current_stage"),
    )


def word_profile(words: DataFrame) -> DataFrame:
    """Flat report row per word. The duration is always given, also for a word that starts at zero."""
    slope = F.col("pitch_slope") if "pitch_slope" in words.columns else F.lit(None).cast("double")
    return words.select(
        "recording_id",
        "word_idx",
        "word",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        slope.alias("pitch_change"),
        "pause_after_ms",
        (F.col("pause_after_ms") > 500).alias("long_pause"),
        pause_class(F.col("word"), F.col("pause_after_ms"), F.col("is_last")).alias("pause_class"),
        "stressed",
        "confidence",
        confidence_band(F.col("confidence")).alias("confidence_band"),
    )


def number_words(words: DataFrame) -> DataFrame:
    """Global word index over phrases in order; ``words(recording_id, phrase_index, pos)``."""
    sizes = words.groupBy("recording_id", "phrase_index").agg(F.count("*").alias("n"))
    offsets = running(sizes, REC, "phrase_index", {"_base": Run("sum", F.col("n"), inclusive=False)}).drop("n")
    return attach(words, offsets, ["recording_id", "phrase_index"], block_of("pos")).withColumn(
        "global_idx", F.col("_base") + F.col("pos")
    ).drop("_base")


#: Decimal places at the sink, by column.
PLACES = {
    **dict.fromkeys(("mean_pitch", "max_pitch", "min_pitch", "start_pitch", "end_pitch", "pitch_range"), 1),
    **dict.fromkeys(("pitch_mean", "pitch_start", "pitch_end", "inton_pitch_range"), 1),
    "pitch_slope": 2,
    "normalized_pitch": 3,
    "stress_score": 3,
}
ARRAY_PLACES = {"char_pitches": 3, "pitch_contour": 1}
PLAIN = ("stressed", "is_hesitation", "pitch_trend", "pitch_direction", "voiced_segment_index")


def _document_word(words: DataFrame) -> Column:
    known = words.columns
    fields = [
        "pos",
        "word",
        F.round(seconds(F.col("start_ms")), 3).alias("start"),
        F.round(seconds(F.col("end_ms")), 3).alias("end"),
        "confidence",
        *[c for c in PLAIN if c in known],
        *[F.round(c, n).alias(c) for c, n in PLACES.items() if c in known],
        *[F.transform(c, lambda v, n=n: F.round(v, n)).alias(c) for c, n in ARRAY_PLACES.items() if c in known],
    ]
    if "pause_after_ms" in known:
        fields.append(F.round(seconds(F.col("pause_after_ms")), 3).alias("pause_after"))
    return F.struct(*fields)


def _piece_bounds(placed: DataFrame, key: list[str]) -> DataFrame:
    """A row per piece of a phrase with start, end and word count of the whole phrase, as ``phrase_bounds`` gives them."""
    sized = placed.groupBy(*key, "_piece").agg(
        F.min("pos").alias("_low"),
        F.max("pos").alias("_high"),
        F.min_by("start_ms", "pos").alias("_start"),
        F.max_by("end_ms", "pos").alias("_end"),
        F.count("*").alias("_n"),
    )
    phrase = Window.partitionBy(*key)
    return sized.select(
        *key,
        "_piece",
        F.min_by("_start", "_low").over(phrase).alias("start_ms"),
        F.max_by("_end", "_high").over(phrase).alias("end_ms"),
        F.sum("_n").over(phrase).alias("n_words"),
    )


def result_phrases(words: DataFrame, patterns: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Phrases of a result document, one row each: bounds and number of words of the phrase, its text, and its words with
    all fields that the analyzers added, rounded for display.

    A phrase above ``PIECE_WORDS`` words goes on in further rows (``first_pos`` tells them apart) with the same bounds.
    ``patterns(recording_id, phrase_index, intonation_pattern)``, ``chunks(recording_id, phrase_index, chunk_index)``.
    """
    key = ["recording_id", "phrase_index"]
    placed = words.withColumn("_piece", F.expr(f"coalesce(pos div {PIECE_WORDS}, -1)"))
    pieces = placed.groupBy(*key, "_piece").agg(F.array_sort(F.collect_list(_document_word(words))).alias("words"))
    # What is known of a phrase is joined to the places of its pieces, so that the words themselves are moved once.
    places = _piece_bounds(placed, key)
    pattern, chunk = F.lit("flat"), F.lit(None).cast("bigint")
    if patterns is not None:
        places, pattern = places.join(patterns.hint("rebalance"), key, "left"), F.coalesce("intonation_pattern", F.lit("flat"))
    if chunks is not None:
        places, chunk = places.join(chunks.hint("rebalance"), key, "left"), F.col("chunk_index")
    rows = pieces.join(places, [*key, "_piece"])
    return rows.select(
        *key,
        F.element_at("words", 1)["pos"].alias("first_pos"),
        F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("text"),
        F.round(seconds(F.col("start_ms")), 3).alias("start_time"),
        F.round(seconds(F.col("end_ms")), 3).alias("end_time"),
        "n_words",
        pattern.alias("intonation_pattern"),
        chunk.alias("chunk_index"),
        "words",
    )


def result_header(rollup: DataFrame) -> DataFrame:
    """The scalars of a result document, rounded for display; ``rollup`` as ``session_summary`` gives it."""
    return rollup.select(
        "recording_id",
        F.round("total_duration", 3).alias("total_duration"),
        "word_count",
        F.round("wpm", 1).alias("wpm"),
        F.round("stress_ratio", 3).alias("stress_ratio"),
        F.round("pitch_variation", 1).alias("pitch_variation"),
    )
