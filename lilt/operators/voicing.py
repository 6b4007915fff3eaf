"""Voiced runs and segments of a pitch track ``(recording_id, frame_idx, f0)``; NULL marks an unvoiced frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.operators.scan import Run, adjacent, running
from lilt.session import cut

# Fixed values, in frames.
MIN_RUN = 3
MIN_SEGMENT = 8
MAX_SEGMENT = 500
REC = ["recording_id"]


def run_bounds(frames: DataFrame) -> DataFrame:
    """Add ``run_start`` and ``run_len`` of the voiced run around each voiced frame (NULL on unvoiced ones).

    A frame without a row is a hole like an unvoiced one: a run starts after either and stops before either.
    """
    at, voiced = F.col("frame_idx"), F.col("f0").isNotNull()
    near = adjacent(
        frames.withColumn("_on", voiced),
        REC,
        "frame_idx",
        lead={"_next": at, "_next_on": F.col("_on")},
        lag={"_prev": at, "_prev_on": F.col("_on")},
        keep="_block",
    )
    starts = voiced & ~F.coalesce(F.col("_prev_on") & (F.col("_prev") == at - 1), F.lit(False))
    stops = voiced & ~F.coalesce(F.col("_next_on") & (F.col("_next") == at + 1), F.lit(False))
    scanned = running(
        near,
        REC,
        "frame_idx",
        {"_start": Run("max", F.when(starts, at)), "_stop": Run("min", F.when(stops, at), backward=True)},
        [F.col("_block")],
    )
    return scanned.withColumns(
        {"run_start": F.when(voiced, F.col("_start")), "run_len": F.when(voiced, F.col("_stop") - F.col("_start") + 1)}
    ).drop("_on", "_next", "_next_on", "_prev", "_prev_on", "_block", "_start", "_stop")


def clean_short_runs(frames: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Runs of fewer than ``min_run`` voiced frames become unvoiced."""
    return run_bounds(frames).withColumn("f0", F.when(F.col("run_len") >= min_run, F.col("f0"))).drop(
        "run_start", "run_len"
    )


def segment_frames(
    frames: DataFrame, min_len: int = MIN_SEGMENT, max_len: int = MAX_SEGMENT, min_run: int = MIN_RUN
) -> DataFrame:
    """Voiced frames with the start of their segment.

    Runs of at least ``min_len`` frames are segments; a run above ``max_len`` is cut into ceil(len / max_len) pieces
    of equal length, the last one taking the remainder, and pieces below ``min_len`` are dropped. All of it is
    arithmetic on the run bounds, so no further shuffle is needed.
    """
    return (
        run_bounds(frames)
        .filter(F.col("run_len") >= max(min_len, min_run))
        .withColumn("_n", F.expr(f"(run_len + {max_len - 1}) div {max_len}"))
        .withColumn("_size", F.expr("run_len div _n"))
        .withColumn("_piece", F.expr("least((frame_idx - run_start) div _size, _n - 1)"))
        .withColumn("start_frame", F.col("run_start") + F.col("_piece") * F.col("_size"))
        .withColumn(
            "_len",
            F.when(F.col("_piece") == F.col("_n") - 1, F.col("run_len") - F.col("_piece") * F.col("_size")).otherwise(
                F.col("_size")
            ),
        )
        .filter(F.col("_len") >= min_len)
        .select("recording_id", "frame_idx", "f0", "start_frame", F.col("_len").alias("segment_len"))
    )


def voiced_segments(frames: DataFrame, min_len: int = MIN_SEGMENT, max_len: int = MAX_SEGMENT) -> DataFrame:
    """One row per segment with its values ``x``, numbered per recording."""
    rows = (
        segment_frames(frames, min_len, max_len)
        .groupBy("recording_id", "start_frame")
        .agg(F.array_sort(F.collect_list(F.struct("frame_idx", "f0"))).alias("p"))
        .select(
            "recording_id",
            "start_frame",
            (F.col("start_frame") + F.size("p") - 1).alias("end_frame"),
            F.transform("p", lambda v: v["f0"]).alias("x"),
        )
    )
    return number_segments(cut(rows, "segments"))


def number_segments(segments: DataFrame) -> DataFrame:
    return running(
        segments,
        REC,
        "start_frame",
        {"segment_index": Run("sum", F.lit(1).cast("bigint"), inclusive=False)},
        blocks=[F.expr("start_frame div 65536")],
    )


def voicing_rate(frames: DataFrame, max_len: int = MAX_SEGMENT) -> DataFrame:
    """Frames, voiced frames after cleaning, their share, and the number and mean length of segments."""
    cleaned = clean_short_runs(frames).groupBy("recording_id").agg(
        F.count("*").alias("n_frames"), F.count("f0").alias("n_voiced")
    )
    segments = (
        segment_frames(frames, max_len=max_len)
        .filter(F.col("frame_idx") == F.col("start_frame"))
        .groupBy("recording_id")
        .agg(
            F.count("*").alias("n_segments"),
            F.min("segment_len").alias("min_segment"),
            F.max("segment_len").alias("max_segment"),
            F.sum("segment_len").alias("segment_frames"),
        )
    )
    return cleaned.join(segments, REC, "left").select(
        "recording_id",
        "n_frames",
        "n_voiced",
        (F.col("n_voiced") / F.col("n_frames")).alias("voiced_share"),
        F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
        "min_segment",
        "max_segment",
        (F.col("segment_frames") / F.col("n_segments")).alias("avg_segment"),
    )


def fill_gaps(frames: DataFrame) -> DataFrame:
    """Linear interpolation over unvoiced frames; the edges hold the nearest voiced value."""
    filled = running(frames, REC, "frame_idx", neighbours())
    at = F.col("frame_idx")
    b, a = F.col("_vb"), F.col("_va")
    between = b["f0"] + (a["f0"] - b["f0"]) * ((at - b["i"]) / (a["i"] - b["i"]))
    value = (
        F.when(F.col("f0").isNotNull(), F.col("f0"))
        .when(b.isNull(), a["f0"])
        .when(a.isNull(), b["f0"])
        .otherwise(between)
    )
    return filled.withColumn("f0_filled", value).drop("_vb", "_va")


def neighbours() -> dict[str, Run]:
    """Nearest voiced frame at or before (``_vb``) and at or after (``_va``) a frame."""
    point = F.when(F.col("f0").isNotNull(), F.struct(F.col("frame_idx").alias("i"), "f0"))
    return {"_vb": Run("last", point), "_va": Run("last", point, backward=True)}
