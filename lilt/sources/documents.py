"""Writers for result tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.functions.documents import typed
from lilt.schemas import RESULT_HEADER, RESULT_PHRASE

KEYS = ("recording_id", "phrase_index", "first_pos")


def as_json(header: DataFrame, phrases: DataFrame, nulls: bool = True) -> DataFrame:
    """Result documents as JSON lines: per recording one line of scalars, then one per phrase (or piece of a long one).

    ``line_kind`` is ``header`` or ``phrase``; a recording's lines in order of ``phrase_index`` and ``first_pos`` (-1 for the
    header) are its document, of any length. Without ``nulls`` a NULL field is left out, so that a reader takes its default.
    """
    options = {"ignoreNullFields": str(not nulls).lower()}
    scalars = [c for c in header.columns if c != "recording_id"]
    first = header.select(
        "recording_id", F.lit(-1).cast("bigint").alias("phrase_index"), F.lit(-1).cast("bigint").alias("first_pos"),
        F.lit("header").alias("line_kind"), F.to_json(F.struct(*scalars), options).alias("line"),
    )
    body = [c for c in phrases.columns if c != "recording_id"]
    rest = phrases.select(
        "recording_id", F.col("phrase_index").cast("bigint"), F.col("first_pos").cast("bigint"),
        F.lit("phrase").alias("line_kind"), F.to_json(F.struct(*body), options).alias("line"),
    )
    return first.unionByName(rest)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines of ``as_json`` read back: ``header`` or ``phrase`` as their models say, and ``ok`` (whether the line keeps to its model)."""
    head = F.col("line_kind") == "header"
    read = lines.withColumn("_json", F.try_parse_json("line")).withColumns(
        {"_h": F.when(head, typed("_json", RESULT_HEADER, "line")), "_p": F.when(~head, typed("_json", RESULT_PHRASE, "line"))}
    )
    return read.select(
        *KEYS, "line_kind", F.when(F.col("_h.ok"), F.col("_h.v")).alias("header"), F.when(F.col("_p.ok"), F.col("_p.v")).alias("phrase"),
        F.coalesce("_h.ok", "_p.ok").alias("ok"),
    )


def write_documents(phrases: DataFrame, path: str, buckets: int = 256) -> None:
    """Write phrases as parquet in folders by hash bucket of the recording, so that one recording reads one folder."""
    placed = phrases.withColumn("bucket", F.pmod(F.xxhash64("recording_id"), F.lit(buckets)))
    placed.write.mode("append").partitionBy("bucket").parquet(path)
