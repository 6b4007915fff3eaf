"""Stylised pitch contours: per-segment piecewise fits, the full contour, and error reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.functions.contour import piece_count
from lilt.functions.linefit import piecewise
from lilt.functions.pitch import octave_log_ratio

REC = ["recording_id"]
STYLED = (
    "recording_id long, segment_index long, start_frame long, end_frame long, k int, x array<double>,"
    " stylized array<double>, breaks array<int>, cost double, error string"
)


def with_piece_count(segments: DataFrame) -> DataFrame:
    return segments.withColumn("k", piece_count(F.col("x")))


def stylize_segments(segments: DataFrame, criterion: str = "mae") -> DataFrame:
    """Fit each segment with its ``k`` pieces: ``mae``, ``mse``, or ``none`` to keep the raw contour.

    One row is one segment. Fitting costs far more than moving the rows, so segments are spread evenly over a fixed
    number of partitions that adaptive execution does not merge by size. A segment that cannot be fitted keeps its raw
    contour and reports the error.
    """

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = []
            for x, k in zip(rows["x"], rows["k"], strict=True):
                try:
                    contour, firsts, cost = piecewise(x, int(k), criterion)
                    done.append((contour, firsts, cost, None))
                except Exception as problem:  # noqa: BLE001 - reported as a column
                    done.append((x, [1], 0.0, f"{type(problem).__name__}: {problem}"))
            yield rows.assign(
                stylized=[d[0] for d in done],
                breaks=[d[1] for d in done],
                cost=[d[2] for d in done],
                error=[d[3] for d in done],
            )

    columns = ["recording_id", "segment_index", "start_frame", "end_frame", "k", "x"]
    if criterion == "none":
        return segments.select(
            *columns,
            F.col("x").alias("stylized"),
            F.array(F.lit(1)).alias("breaks"),
            F.lit(0.0).alias("cost"),
            F.lit(None).cast("string").alias("error"),
        )
    spark = segments.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = segments.select(*columns).repartition(width, "recording_id", "start_frame")
    return spread.mapInPandas(fit, STYLED)


def full_contour(frames: DataFrame, styled: DataFrame) -> DataFrame:
    """Stylised values back on the frame axis; NULL outside segments."""
    points = styled.select("recording_id", "start_frame", F.posexplode("stylized").alias("i", "value")).select(
        "recording_id", (F.col("start_frame") + F.col("i")).alias("frame_idx"), "value"
    )
    return frames.select("recording_id", "frame_idx").join(points, ["recording_id", "frame_idx"], "left")


def contour_range(contour: DataFrame) -> DataFrame:
    """Lowest and highest contour value per recording; (0, 1) for a recording without any."""
    return contour.groupBy("recording_id").agg(
        F.coalesce(F.min("value"), F.lit(0.0)).alias("low"), F.coalesce(F.max("value"), F.lit(1.0)).alias("high")
    )


def line_per_segment(segment_frames: DataFrame) -> DataFrame:
    """Least-squares line of each segment over frames 1..n, straight from the frame rows."""
    n = (F.col("frame_idx") - F.col("start_frame") + 1).cast("double")
    return segment_frames.groupBy("recording_id", "start_frame").agg(
        F.count("*").alias("n"),
        F.regr_slope("f0", n).alias("slope"),
        F.regr_intercept("f0", n).alias("intercept"),
    )


def line_contour(segment_frames: DataFrame) -> DataFrame:
    """Frames with the value of the least-squares line of their segment.

    The line is joined back per (recording, segment), and segments are bounded by their longest allowed length.
    """
    n = F.col("frame_idx") - F.col("start_frame") + 1
    lines = line_per_segment(segment_frames).select("recording_id", "start_frame", "slope", "intercept")
    return segment_frames.join(lines, ["recording_id", "start_frame"]).withColumn(
        "line", F.col("intercept") + F.col("slope") * n
    )


def rmse_report(mse: DataFrame, mae: DataFrame) -> DataFrame:
    """Mean over segments of the RMSE of both contours, and the difference."""

    def rmse(column):
        squares = F.aggregate(
            F.zip_with("x", column, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
        )
        return F.sqrt(squares / F.size("x"))

    key = ["recording_id", "segment_index"]
    both = mse.select(*key, "x", F.col("stylized").alias("by_square")).join(
        mae.select(*key, F.col("stylized").alias("by_absolute")), key
    )
    return both.agg(
        F.count("*").alias("n_segments"),
        F.avg(rmse("by_square")).alias("mse_rmse"),
        F.avg(rmse("by_absolute")).alias("mae_rmse"),
    ).withColumn("improvement", F.col("mse_rmse") - F.col("mae_rmse"))


def octave_histogram(points: DataFrame, bins: int = 40) -> DataFrame:
    """Histogram of log2(estimate / reference) in ``bins`` equal bins; flags bins near an octave error.

    ``points(estimate, reference)``. The range comes from a scalar subquery, the counts from partial aggregation.
    """
    ratios = points.select(octave_log_ratio(F.col("estimate"), F.col("reference")).alias("lr")).filter(
        F.col("lr").isNotNull()
    )
    extent = ratios.agg(F.min("lr").alias("low"), F.max("lr").alias("high"), F.count("*").alias("total"))
    width = (F.col("high") - F.col("low")) / bins
    placed = ratios.withColumn("_e", extent.select(F.struct("low", "high", "total")).scalar()).select("lr", "_e.*").withColumn(
        "bin",
        F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("lr") - F.col("low")) / width), F.lit(bins - 1)))
        .otherwise(0)
        .cast("int"),
    )
    counted = placed.groupBy("bin").agg(F.count("*").alias("n"))
    # All bins are there, also those without a point; an input without points has none.
    grid = extent.where("total > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counted = grid.select("bin", "low", "high", "total").join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    center = F.col("low") + (F.col("bin") + 0.5) * width
    return counted.select(
        "bin",
        "n",
        (F.col("low") + F.col("bin") * width).alias("left_edge"),
        (F.col("n") / (F.col("total") * width)).alias("density"),
        F.when(F.abs(center - 1) <= 0.1, "doubling").when(F.abs(center + 1) <= 0.1, "halving").alias("octave"),
    )
