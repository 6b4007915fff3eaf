"""Operators over sample blocks ``(recording_id, block_idx, start_sample, samples)`` and encoded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.operators.scan import adjacent, attach, block_of, totalled

REC = ["recording_id"]
#: Sample blocks of a recording that look up its gain together.
GAIN_BLOCKS = 256


def peak_abs(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("recording_id").agg(
        F.max(F.array_max(F.transform("samples", F.abs))).cast("double").alias("peak")
    )


def peak_gain(blocks: DataFrame) -> DataFrame:
    """Scale quiet recordings (peak between 1e-4 and 0.5) to a peak of 0.85."""
    peak = F.col("peak")
    gain = F.when((peak > 1e-4) & (peak < 0.5), F.lit(0.85) / peak).otherwise(F.lit(1.0))
    # One number per recording, looked up once for each stretch of its blocks.
    ranged = attach(blocks, peak_abs(blocks), REC, block_of("block_idx", GAIN_BLOCKS)).withColumn("gain", gain)
    return ranged.withColumn("samples", F.transform("samples", lambda x: x.cast("double") * F.col("gain"))).drop("peak")


def rms_per_second(blocks: DataFrame, rate: int) -> DataFrame:
    """Root mean square per second. A block adds one partial sum for each second it touches."""
    n = F.size("samples")
    whole = blocks.filter(n > 0).withColumn(
        "second", F.explode(F.expr(f"sequence(start_sample div {rate}, (start_sample + size(samples) - 1) div {rate})"))
    )
    first = F.expr(f"cast(greatest(second * {rate} - start_sample, 0) as int)")
    last = F.expr(f"cast(least((second + 1) * {rate} - start_sample, size(samples)) as int)")
    part = F.slice("samples", first + 1, last - first)
    energy = F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (
        whole.select("recording_id", "second", energy.alias("e"), (last - first).alias("n"))
        .groupBy("recording_id", "second")
        .agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
        .select("recording_id", "second", F.sqrt(F.col("e") / F.col("n")).alias("rms"))
    )


def slice_by_phrase(phrases: DataFrame, blocks: DataFrame, rate: int, block_samples: int) -> DataFrame:
    """Samples [start, end) of each phrase as one row per touched block, clamped to the audio.

    ``phrases(recording_id, phrase_index, start_ms, end_ms)``. The pieces of a phrase in order of ``block_idx`` are its
    audio; they stay apart so that no row grows with the phrase.
    """
    wanted = phrases.select(
        "recording_id",
        "phrase_index",
        F.expr(f"start_ms * {rate} div 1000").alias("a"),
        F.expr(f"end_ms * {rate} div 1000").alias("b"),
    ).filter("a < b")
    touched = wanted.withColumn(
        "block_idx", F.explode(F.expr(f"sequence(a div {block_samples}, (b - 1) div {block_samples})"))
    )
    joined = touched.join(blocks, ["recording_id", "block_idx"])
    first = F.expr("cast(greatest(a - start_sample, 0) as int)")
    last = F.expr("cast(least(b - start_sample, size(samples)) as int)")
    return joined.filter(first < last).select(
        "recording_id", "phrase_index", "block_idx", F.slice("samples", first + 1, last - first).alias("samples")
    )


def concat_chunks(chunks: DataFrame) -> DataFrame:
    """Audio chunks of a session as one byte stream: each chunk with its ``offset`` and the session's ``total_bytes``.

    Reading the rows in order of ``offset`` gives the joined audio, whatever its length; no row grows with the session.
    """
    audio = chunks.filter(F.col("kind") == "audio").withColumn("n_bytes", F.octet_length("content").cast("bigint"))
    sizes = audio.select("recording_id", "seq", "n_bytes")
    # The contents meet their places by chunk, and are moved that once.
    placed = totalled(sizes, REC, "seq", "n_bytes", "offset", "total_bytes").drop("n_bytes")
    return audio.join(placed, ["recording_id", "seq"]).select("recording_id", "seq", "offset", "n_bytes", "total_bytes", "content")


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """Audio chunks whose content equals that of the chunk before; only digests are shuffled."""
    audio = chunks.filter(F.col("kind") == "audio").select(
        "recording_id", "seq", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("digest")
    )
    near = adjacent(audio, REC, "seq", lag={"before": F.col("digest")})
    return near.withColumn("same_as_previous", F.coalesce(F.col("digest") == F.col("before"), F.lit(False))).drop(
        "before", "digest"
    )
