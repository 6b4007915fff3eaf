"""Recordings as files, containers and sample blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lilt.operators.scan import Run, adjacent, running
from lilt.session import cut

# Container markers of a cluster and of a header.
CLUSTER_MARKER = "1F43B675"
HEADER_MARKER = "1A45DFA3"
#: Bytes of content that are decoded together, or one longer chunk.
DECODE_BYTES = 1 << 20


def scan_recordings(spark: SparkSession, path: str, suffix: str = "webm") -> DataFrame:
    """Files ``{id}.{suffix}`` below ``path`` with their size; the content column is pruned and never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path)
    return files.select(
        F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1).alias("file_id"),
        F.col("length").alias("n_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def decode_pcm(chunks: DataFrame) -> DataFrame:
    """16-bit little-endian samples to floats in [-1, 1): column ``content`` becomes ``samples``.

    Decoded chunks leave a task a megabyte of content at a time, however many rows a batch holds.
    """
    schema = "recording_id long, seq long, samples array<float>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = pc.fill_null(pc.binary_length(rows.column("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // DECODE_BYTES
            starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(part)]):
                piece = rows.slice(a, b - a)
                samples = [np.frombuffer(c[: len(c) // 2 * 2], dtype="<i2") for c in piece.column("content").to_pylist()]
                offsets = np.cumsum([0, *map(len, samples)]).astype(np.int32)
                values = np.concatenate(samples).astype(np.float32) / np.float32(32768)
                columns = [piece.column("recording_id"), piece.column("seq"), pa.ListArray.from_arrays(offsets, values)]
                yield pa.RecordBatch.from_arrays(columns, ["recording_id", "seq", "samples"])

    return chunks.select("recording_id", "seq", "content").mapInArrow(decode, schema)


def marker_spans(files: DataFrame, key: str, marker: str = CLUSTER_MARKER) -> DataFrame:
    """Positions of a marker in a binary column ``content``, sizes up to the next one or the end, and digests.

    Splitting the one-byte text at the marker gives all spans in one pass over the content. Only their lengths and
    digests are written and scanned for the positions.
    """
    text = F.decode("content", "ISO-8859-1")
    literal = F.decode(F.unhex(F.lit(marker)), "ISO-8859-1")
    size = len(marker) // 2
    pieces = files.select(key, text.alias("t"), literal.alias("m")).select(
        key, F.posexplode(F.split("t", F.concat(F.lit("\\Q"), F.col("m"), F.lit("\\E")), -1)).alias("i", "piece")
    )
    spans = pieces.select(
        key,
        F.col("i").cast("bigint").alias("i"),
        (F.length("piece") + F.when(F.col("i") > 0, size).otherwise(0)).cast("bigint").alias("n_bytes"),
        F.sha2(F.encode("piece", "ISO-8859-1"), 256).alias("digest"),
    )
    placed = running(cut(spans, "spans"), [key], "i", {"position": Run("sum", F.col("n_bytes"), inclusive=False)})
    return placed.filter(F.col("i") > 0).select(
        key, (F.col("i") - 1).alias("span_idx"), "position", "n_bytes", "digest"
    )


def marker_count(files: DataFrame, key: str, marker: str = HEADER_MARKER) -> DataFrame:
    text, literal = F.decode("content", "ISO-8859-1"), F.decode(F.unhex(F.lit(marker)), "ISO-8859-1")
    gone = F.length(F.replace(text, literal))
    return files.select(key, ((F.length(text) - gone) / (len(marker) // 2)).cast("bigint").alias("n_markers"))


def repeated_spans(spans: DataFrame, key: str) -> DataFrame:
    """Spans with the same content as the span before them."""
    near = adjacent(spans, [key], "span_idx", lag={"before": F.col("digest")})
    return near.withColumn("same_as_previous", F.coalesce(F.col("digest") == F.col("before"), F.lit(False))).drop(
        "before", "digest"
    )
