"""Speech segments to recogniser-sized chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.operators.chain import bounded_spans
from lilt.operators.scan import Run, adjacent, attach, block_of, running

# Padding, longest piece, chunk target and closing pause, in milliseconds.
PAD_MS = 150
MAX_MS = 29_000
TARGET_MS = 25_000
PAUSE_MS = 1_200
# Span of one block of the greedy scan.
BLOCK_MS = 3_600_000
REC = ["recording_id"]


def with_fallback(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """A recording without speech segments counts as one segment over its full length."""
    silent = recordings.join(segments.select("recording_id").distinct(), REC, "left_anti")
    whole = silent.select(
        "recording_id",
        F.lit(0).cast("bigint").alias("seg_idx"),
        F.lit(0).cast("bigint").alias("start_sample"),
        F.expr("duration_ms * sample_rate div 1000").alias("end_sample"),
    )
    return segments.select(whole.columns).unionByName(whole)


def pad_and_split(
    segments: DataFrame, recordings: DataFrame, rate: int = 16_000, max_ms: int = MAX_MS
) -> DataFrame:
    """Pad by 150 ms within the recording; cut a longer piece than ``max_ms`` into equal parts."""
    pad, longest = PAD_MS * rate // 1000, max_ms * rate // 1000
    length = recordings.select("recording_id", F.expr("duration_ms * sample_rate div 1000").alias("_n"))
    padded = attach(segments, length, REC, block_of("seg_idx"), "inner").select(
        "recording_id",
        "seg_idx",
        F.greatest(F.lit(0), F.col("start_sample") - pad).alias("s"),
        F.least("_n", F.col("end_sample") + pad).alias("e"),
    )
    return (
        padded.withColumn("n", F.expr(f"greatest(1, (e - s + {longest - 1}) div {longest})"))
        .withColumn("step", F.expr("(e - s) div n"))
        .select("recording_id", "seg_idx", "s", "e", "n", "step", F.explode(F.expr("sequence(0, n - 1)")).alias("part"))
        .select(
            "recording_id",
            "seg_idx",
            F.col("part").cast("bigint").alias("part"),
            (F.col("s") + F.col("part") * F.col("step")).alias("start_sample"),
            F.when(F.col("part") == F.col("n") - 1, F.col("e"))
            .otherwise(F.col("s") + (F.col("part") + 1) * F.col("step"))
            .alias("end_sample"),
        )
    )


def merge_chunks(
    pieces: DataFrame, rate: int = 16_000, target_ms: int = TARGET_MS, block_ms: int = BLOCK_MS
) -> DataFrame:
    """Greedy chunks of at most ``target_ms``, also closed by a pause of 1.2 s; a single longer piece stays whole."""
    per_ms = rate // 1000
    block = max(block_ms, 2 * target_ms) * per_ms
    grouped = bounded_spans(pieces, PAUSE_MS * per_ms, target_ms * per_ms, block)
    at = F.struct("start_sample", "seg_idx", "part")
    chunks = grouped.groupBy("recording_id", F.col("group_start").alias("start_sample")).agg(
        F.max_by("end_sample", at).alias("end_sample"), F.count("*").alias("n_segments")
    )
    return running(
        chunks,
        REC,
        "start_sample",
        {"chunk_index": Run("sum", F.lit(1).cast("bigint"), inclusive=False)},
        blocks=[F.expr(f"start_sample div {block}"), F.expr(f"start_sample div {block * 4096}")],
    ).withColumns(
        {
            "start_ms": F.expr(f"start_sample div {per_ms}"),
            "end_ms": F.expr(f"end_sample div {per_ms}"),
        }
    )


def chunk_quality(chunks: DataFrame, recordings: DataFrame) -> DataFrame:
    """Count, shortest, longest and mean duration, and the share of the recording that is covered."""
    return (
        chunks.withColumn("d", F.col("end_ms") - F.col("start_ms"))
        .groupBy("recording_id")
        .agg(
            F.count("*").alias("n_chunks"),
            F.min("d").alias("min_ms"),
            F.max("d").alias("max_ms"),
            F.sum("d").alias("covered_ms"),
        )
        .join(recordings, REC)
        .select(
            "recording_id", "n_chunks", "min_ms", "max_ms", "covered_ms",
            (F.col("covered_ms") / F.col("n_chunks")).alias("avg_ms"),
            (F.col("covered_ms") / F.col("duration_ms")).alias("coverage"),
        )
    )


def order_checks(chunks: DataFrame, bound_ms: int = MAX_MS) -> DataFrame:
    """Per recording: starts increase, chunks do not overlap by more than 10 ms, none is empty, all are bounded."""
    near = adjacent(chunks, REC, "chunk_index", lead={"_next": F.col("start_ms")})
    good = lambda c: F.bool_and(F.coalesce(c, F.lit(True)))
    return near.groupBy("recording_id").agg(
        good(F.col("start_ms") < F.col("_next")).alias("ordered"),
        good(F.col("end_ms") <= F.col("_next") + 10).alias("disjoint"),
        good(F.col("end_ms") > F.col("start_ms")).alias("non_empty"),
        good(F.col("end_ms") - F.col("start_ms") <= bound_ms).alias("bounded"),
    )


def utterances(words: DataFrame, gap_ms: int = PAUSE_MS) -> DataFrame:
    """Utterances separated by silences of at least ``gap_ms``."""
    near = adjacent(words, REC, "word_idx", lag={"_prev": F.col("end_ms")}, keep="_block")
    opens = F.when(F.col("start_ms") - F.col("_prev") >= gap_ms, 1).otherwise(0).cast("bigint")
    return (
        running(near, REC, "word_idx", {"utterance": Run("sum", opens)}, [F.col("_block")])
        .groupBy("recording_id", "utterance")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"))
    )
