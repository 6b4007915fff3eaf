"""Corpus preparation in five stages, each on all that the one before it kept.

Language id learns from the labelled documents outside the held-out fifth and rejects documents without a letter and long ones
whose grams no learned language holds. Line dedup replaces texts by their kept lines. The n-gram Jaccard join leaves
one document of each component. Mixing takes documents up to twice, to their sources' targets. Packing gives the sequences.

Without any learned language nothing can be told foreign, so language id then keeps all documents.

Edges are those of the operators; a table without documents gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lilt.llm import jaccard_join, language_id, line_dedup, mixing, packing
from lilt.llm.queries import table, tokenizer
from lilt.session import cut

#: Texts of at least this many characters are rejected below this score.
JUDGED_CHARS = 40
LEAST_SCORE = 0.2

ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = language_id.learn(docs.where(~language_id.held_out()))
    if not filters.languages:
        return docs
    found = language_id.predict(docs, filters)
    foreign = (F.col("score") < LEAST_SCORE) & (F.length("text") >= JUDGED_CHARS)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~foreign).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs)
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), tokenizer(), keep_ids=False))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("best_two_fit", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
