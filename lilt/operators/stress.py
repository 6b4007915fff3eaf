"""Stress labels: normalisation and alignment to words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.functions.tokens import clean_token_weak
from lilt.operators.scan import attach, block_of
from lilt.session import cut, discard


def normalize_labels(labels: DataFrame) -> DataFrame:
    """Model output (word, label) to (word, stressed, stress_score)."""
    hit = F.col("label") == 1
    return labels.withColumns(
        {"word": F.trim("word"), "stressed": F.coalesce(hit, F.lit(False)), "stress_score": F.when(hit, 1.0).otherwise(0.0)}
    ).drop("label")


def align_stress(words: DataFrame, labels: DataFrame, scope: str = "phrase_index", written: bool = False) -> DataFrame:
    """Give each word the label at its position if one text is a prefix of the other, else the first label of the
    phrase with equal text, else none (not stressed, score 0). A label may serve several words.

    ``labels(recording_id, <scope>, pos, word, stressed, stress_score)``. With ``written`` the words are written as a table, for
    plans that read them more than once; so are those with the label at their place on the way, which are joined once then.
    """
    here, text = ["recording_id", scope, "pos"], ["recording_id", scope, "_token"]
    given = labels.select(*here, clean_token_weak(F.col("word")).alias("_label"),
                          F.struct("stressed", "stress_score").alias("_hit"))
    # The same text may fill much of a phrase, hence the lookup by block.
    first = (
        given.groupBy("recording_id", scope, F.col("_label").alias("_token"))
        .agg(F.min_by("_hit.stressed", "pos").alias("_a"), F.min_by("_hit.stress_score", "pos").alias("_b"))
        .select(*text, F.struct(F.col("_a").alias("stressed"), F.col("_b").alias("stress_score")).alias("_found"))
    )
    placed = words.withColumn("_token", clean_token_weak(F.col("word"))).join(given, here, "left")
    if written:
        placed = cut(placed, "placed", "zstd", tidy=True)
    # Most words take the label at their place, and are moved that once; only the others look their text up.
    near = F.coalesce(F.col("_token").startswith(F.col("_label")) | F.col("_label").startswith(F.col("_token")), F.lit(False))
    taken = placed.where(near).withColumnRenamed("_hit", "_best")
    looked = attach(placed.where(~near).drop("_hit"), first, text, block_of("pos")).withColumnRenamed("_found", "_best")
    aligned = taken.unionByName(looked).withColumns(
        {
            "stressed": F.coalesce("_best.stressed", F.lit(False)),
            "stress_score": F.coalesce("_best.stress_score", F.lit(0.0)),
        }
    ).drop("_token", "_label", "_best")
    if not written:
        return aligned
    aligned = cut(aligned, "aligned", "zstd", tidy=True)
    discard(placed)
    return aligned
