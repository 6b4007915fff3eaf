"""Pitch per word: interval join of words and frames, features, contours and sentence intonation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lilt.functions.pitch import normalize_pitch, pitch_direction, pitch_trend
from lilt.functions.tokens import char_count
from lilt.operators.scan import Run, attach, block_of, running
from lilt.operators.stylize import contour_range
from lilt.operators.voicing import neighbours

REC = ["recording_id"]
CELL_FRAMES = 32
SEGMENT_CELL = 512


def _frame_span(words: DataFrame, hop_ms: int) -> DataFrame:
    """First and last frame inside a word; both ends count."""
    return words.withColumns(
        {
            "first_frame": F.expr(f"(start_ms + {hop_ms - 1}) div {hop_ms}"),
            "last_frame": F.expr(f"end_ms div {hop_ms}"),
        }
    )


def words_x_frames(words: DataFrame, frames: DataFrame, hop_ms: int = 10) -> DataFrame:
    """Words with each frame they cover; a word without frames stays, with NULL.

    The interval join is an equi-join on cells of 32 frames: a word meets only the cells it touches.
    """
    spanned = _frame_span(words, hop_ms)
    cells = F.when(
        F.col("first_frame") <= F.col("last_frame"),
        F.expr(f"sequence(first_frame div {CELL_FRAMES}, last_frame div {CELL_FRAMES})"),
    )
    placed = spanned.withColumn("_cell", F.explode_outer(cells))
    points = frames.withColumn("_cell", F.expr(f"frame_idx div {CELL_FRAMES}"))
    w, p = placed.alias("w"), points.alias("p")
    inside = F.col("p.frame_idx").between(F.col("w.first_frame"), F.col("w.last_frame"))
    match = (F.col("w.recording_id") == F.col("p.recording_id")) & (F.col("w._cell") == F.col("p._cell")) & inside
    extra = [c for c in points.columns if c not in ("recording_id", "_cell")]
    return w.join(p, match, "left").select("w.*", *[F.col(f"p.{c}") for c in extra]).drop("_cell")


def _per_word(words: DataFrame, frames: DataFrame, value: str, hop_ms: int, keep: list[str]) -> DataFrame:
    """Statistics of the voiced frames of each word; partial sums, so a word may have any number of frames."""
    v, at = F.col(value), F.col("frame_idx")
    joined = words_x_frames(words, frames.select("recording_id", "frame_idx", value), hop_ms)
    voiced_at = F.when(v.isNotNull(), at)
    return joined.groupBy("recording_id", "word_idx").agg(
        *[F.first(c).alias(c) for c in [*keep, "first_frame", "last_frame"]],
        F.count(v).alias("n_voiced"),
        F.count(at).alias("n_frames"),
        F.avg(v).alias("mean"),
        F.max(v).alias("top"),
        F.min(v).alias("bottom"),
        F.min_by(v, voiced_at).alias("first_value"),
        F.max_by(v, voiced_at).alias("last_value"),
        F.min(at).alias("_f0"),
        F.min(voiced_at).alias("_vf"),
    )


def _lookup_points(stats: DataFrame, table: DataFrame, key: str, base: str, size: str, points: str) -> DataFrame:
    """Values at ``points`` equal steps over ``size`` entries of ``table`` that start at ``base``, by key lookup."""
    step = f"(i * ({size} - 1) / greatest({points} - 1, 1))"
    asked = (
        stats.filter(f"{size} > 0")
        .select("recording_id", "word_idx", "first_frame", "last_frame", base, size, points,
                F.explode(F.expr(f"sequence(0, {points} - 1)")).alias("i"))
        .withColumn("at", F.expr(step))
        .select("*", F.explode(F.expr(f"array_distinct(array(floor(at), ceil(at)))")).alias("_o"))
        .withColumn(key, F.col(base) + F.col("_o"))
    )
    return asked.join(table, ["recording_id", key])


def _interpolate(found: DataFrame, value: str, out: str) -> DataFrame:
    low = F.min_by(value, "_o")
    high = F.max_by(value, "_o")
    part = F.first(F.expr("at - floor(at)"))
    one = found.groupBy("recording_id", "word_idx", "i").agg((low + (high - low) * part).alias("v"))
    return one.groupBy("recording_id", "word_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias(out)
    )


def word_pitch_features(words: DataFrame, contour: DataFrame, segments: DataFrame, hop_ms: int = 10) -> DataFrame:
    """Features of each word on the stylised contour; all NULL for an unvoiced word.

    ``contour(recording_id, frame_idx, value)``, ``segments(recording_id, segment_index, start_frame, end_frame)``.
    Only the contour's voiced frames are moved.
    """
    contour = contour.select("recording_id", "frame_idx", "value").filter("value IS NOT NULL")
    bounds = contour_range(contour)
    keep = ["word", "start_ms", "end_ms"]
    stats = _char_values(words.select("recording_id", "word_idx", *keep), contour, hop_ms, keep)
    ranged = attach(stats, bounds, REC, block_of("word_idx"))
    low, high = F.col("low"), F.col("high")
    flat = (F.col("n_voiced") < 2) | (F.col("n_chars") <= 1)
    level = normalize_pitch(F.col("mean"), low, high)
    chars = F.when(
        F.col("n_voiced") > 0,
        F.when(flat, F.array_repeat(level, F.col("n_chars"))).otherwise(
            F.transform("_points", lambda v: normalize_pitch(v, low, high))
        ),
    )
    featured = ranged.select(
        "recording_id",
        "word_idx",
        *keep,
        F.col("mean").alias("mean_pitch"),
        F.col("top").alias("max_pitch"),
        F.col("bottom").alias("min_pitch"),
        F.col("first_value").alias("start_pitch"),
        F.col("last_value").alias("end_pitch"),
        (F.col("last_value") - F.col("first_value")).alias("pitch_slope"),
        (F.col("top") - F.col("bottom")).alias("pitch_range"),
        level.alias("normalized_pitch"),
        pitch_trend(F.col("first_value"), F.col("last_value"), F.col("mean")).alias("pitch_trend"),
        chars.alias("char_pitches"),
    )
    placed = word_in_segment(featured, segments, hop_ms)
    return placed.withColumn(
        "voiced_segment_index", F.when(F.col("mean_pitch").isNotNull(), F.col("voiced_segment_index"))
    )


def _char_values(words: DataFrame, voiced: DataFrame, hop_ms: int, keep: list[str]) -> DataFrame:
    """Statistics of each word and one value per character, looked up by the rank of the voiced frames."""
    ranked = running(voiced, REC, "frame_idx", {"_rank": Run("sum", F.lit(1).cast("bigint"), inclusive=False)})
    stats = _per_word(words, voiced, "value", hop_ms, keep).withColumn("n_chars", char_count(F.col("word")))
    starts = ranked.select("recording_id", F.col("frame_idx").alias("_vf"), F.col("_rank").alias("_r0"))
    placed = stats.join(starts, ["recording_id", "_vf"], "left")
    found = _lookup_points(placed, ranked.select("recording_id", "_rank", "value"), "_rank", "_r0", "n_voiced", "n_chars")
    return placed.join(_interpolate(found, "value", "_points"), ["recording_id", "word_idx"], "left")


def word_in_segment(words: DataFrame, segments: DataFrame, hop_ms: int = 10) -> DataFrame:
    """Voiced segment that holds the midpoint of the word. Segments are disjoint, so at most one does."""
    mid = F.expr(f"(start_ms + end_ms) div {2 * hop_ms}")
    placed = words.withColumns({"_mid2": F.expr("start_ms + end_ms"), "_cell": (mid / SEGMENT_CELL).cast("bigint")})
    spans = segments.select(
        "recording_id",
        F.col("segment_index").alias("voiced_segment_index"),
        (F.col("start_frame") * 2 * hop_ms).alias("_from"),
        (F.col("end_frame") * 2 * hop_ms).alias("_to"),
        F.explode(F.expr(f"sequence(start_frame div {SEGMENT_CELL}, end_frame div {SEGMENT_CELL})")).alias("_cell"),
    )
    w, s = placed.alias("w"), spans.alias("s")
    match = (
        (F.col("w.recording_id") == F.col("s.recording_id"))
        & (F.col("w._cell") == F.col("s._cell"))
        & F.col("w._mid2").between(F.col("s._from"), F.col("s._to"))
    )
    return w.join(s, match, "left").select("w.*", "s.voiced_segment_index").drop("_mid2", "_cell")


def word_intonation(words: DataFrame, frames: DataFrame, hop_ms: int = 32) -> DataFrame:
    """Intonation of each word on the raw track: at least two voiced frames, else unvoiced and NULL.

    The contour fills unvoiced frames inside the word and takes one value per character.
    """
    keep = ["phrase_index", "pos", "word", "start_ms", "end_ms"]
    stats = _char_tones(words.select("recording_id", "word_idx", *keep), frames, hop_ms, keep)
    enough = F.col("n_voiced") >= 2

    def known_only(c):
        return F.when(enough, c)

    return stats.select(
        "recording_id",
        "word_idx",
        *keep,
        known_only(F.col("mean")).alias("pitch_mean"),
        known_only(F.col("first_value")).alias("pitch_start"),
        known_only(F.col("last_value")).alias("pitch_end"),
        pitch_direction(F.col("first_value"), F.col("last_value"), F.col("n_voiced")).alias("pitch_direction"),
        F.when(enough, F.col("top") - F.col("bottom")).otherwise(F.lit(0.0)).alias("inton_pitch_range"),
        F.coalesce(known_only(F.col("_points")), F.expr("cast(array() as array<double>)")).alias("pitch_contour"),
    )


def _char_tones(words: DataFrame, frames: DataFrame, hop_ms: int, keep: list[str]) -> DataFrame:
    """Statistics of each word and one value per character from the nearest voiced frames on both sides inside it."""
    far = _per_word(words, frames, "f0", hop_ms, keep).withColumn("n_chars", F.length("word"))
    known = running(frames.select("recording_id", "frame_idx", "f0"), REC, "frame_idx", neighbours()).drop("f0")
    found = _lookup_points(far.filter("n_voiced >= 2"), known, "frame_idx", "_f0", "n_frames", "n_chars")
    found = found.withColumns(
        {
            "_b": F.when(F.col("_vb.i") >= F.col("first_frame"), F.col("_vb")),
            "_a": F.when(F.col("_va.i") <= F.col("last_frame"), F.col("_va")),
        }
    ).withColumn(
        "value",
        F.expr(
            "CASE WHEN _b IS NULL THEN _a.f0 WHEN _a IS NULL OR _a.i = _b.i THEN _b.f0"
            " ELSE _b.f0 + (_a.f0 - _b.f0) * ((frame_idx - _b.i) / (_a.i - _b.i)) END"
        ),
    )
    return far.join(_interpolate(found, "value", "_points"), ["recording_id", "word_idx"], "left")


def sentence_intonation(word_rows: DataFrame) -> DataFrame:
    """Direction of the last voiced word of a phrase; rise-fall when the voiced word before it rises and it falls."""
    voiced = F.col("pitch_direction") != "unvoiced"
    seen = F.when(voiced, F.struct("phrase_index", "pitch_direction"))
    chained = running(word_rows, REC, "word_idx", {"_prev": Run("last", seen, inclusive=False)})
    before = F.when(F.col("_prev.phrase_index") == F.col("phrase_index"), F.col("_prev.pitch_direction"))
    last = F.max_by(
        F.struct(F.col("pitch_direction").alias("final"), before.alias("penult")), F.when(voiced, F.col("word_idx"))
    )
    return (
        chained.groupBy("recording_id", "phrase_index")
        .agg(last.alias("e"))
        .select(
            "recording_id",
            "phrase_index",
            F.when((F.col("e.penult") == "rising") & (F.col("e.final") == "falling"), "rise-fall")
            .otherwise(F.coalesce("e.final", F.lit("flat")))
            .alias("intonation_pattern"),
        )
    )
