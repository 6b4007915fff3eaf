"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code point order (NULL last) get the weights of a repeating cycle and share ``budget`` times all sizes; a
source's target stops at ``cap`` times its size and the excess goes to the others by weight. A source repeats all its
documents as often as its target holds it whole. For the rest it counts documents by exact length, takes the same share
of every length, and closes the remaining budget by a bounded-knapsack dynamic programme over length counts. The
documents of a length are chosen by a seeded hash, so reruns agree.

Only (source, length, count) rows meet in one task per source; they are bounded by the number of different lengths. The
choice among the documents of one length splits their hashes into buckets of about 512, so a length or a group of copies
that holds a third of all rows is never ranked in one task.

Edges: NULL or empty texts have size 0 and are taken never; an empty table gives an empty table; repeated rows are chosen
independently; further columns are kept as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lilt.llm.common import WORD, row_columns, whole_row

BUCKET_ROWS = 512
#: Words that the dynamic programme closes; above it lengths are taken greedily. So many lengths are tried first.
PROGRAMME_WORDS = 1 << 15
PROGRAMME_LENGTHS = 512


def words_in(text: Column) -> Column:
    """Number of words, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """(source, source_size) to its target by water filling; one row per source, ordered in Spark."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rated = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights)))
        .withColumn("most", F.col("source_size") * float(cap))
        .withColumn("total", F.sum("source_size").over(everything) * float(budget))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", "rank")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum("weight").over(everything) - F.sum("weight").over(upto)
    level = F.when(after > 1e-9, (F.col("total") - F.sum("most").over(upto)) / after)
    fits = F.when(level <= F.lead("ratio").over(by_ratio), F.struct(F.row_number().over(by_ratio).alias("at"), level.alias("level")))
    first = F.col("total") / F.sum("weight").over(everything)
    leveled = (
        rated.withColumn("fits", fits)
        .withColumn("flat", F.when(first <= F.min("ratio").over(everything), first))
        .withColumn("level", F.coalesce("flat", F.min("fits").over(everything)["level"], F.lit(float("inf"))))
    )
    return leveled.select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def fit_lengths(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take, so that their words come as near to the budget from below as found."""
    total = sum(x * n for x, n in zip(lengths, counts))
    budget = max(0, min(budget, total))
    if not total:
        return [0] * len(lengths)
    taken = [n * budget // total if x else 0 for x, n in zip(lengths, counts)]
    rest = budget - sum(x * k for x, k in zip(lengths, taken))
    for i in sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: -lengths[i]):
        more = min(counts[i] - taken[i], max(0, rest - PROGRAMME_WORDS) // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    able = sorted((i for i in range(len(lengths)) if 0 < lengths[i] <= rest and counts[i] > taken[i]), key=lambda i: lengths[i])
    # A spread of lengths comes first, as it mostly closes the budget; until that is closed, all others follow.
    step = max(1, -(-len(able) // PROGRAMME_LENGTHS))
    limit, reach, layers = (1 << (rest + 1)) - 1, 1, []
    for i in [*able[::step], *(i for k, i in enumerate(able) if k % step)]:
        left, part = min(counts[i] - taken[i], rest // lengths[i]), 1
        while left > 0 and not reach >> rest & 1:
            part = min(part, left)
            wider = (reach | reach << lengths[i] * part) & limit
            if wider != reach:
                layers.append((i, part, reach))
                reach = wider
            left, part = left - part, part * 2
    at = reach.bit_length() - 1
    for i, part, before in reversed(layers):
        if not before >> at & 1:
            taken[i] += part
            at -= lengths[i] * part
    return taken


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = int(target // size) if size else 0
    extra = fit_lengths(rows["size"].astype(int).tolist(), rows["n"].astype(int).tolist(), round(target - whole * size))
    return rows.assign(whole=whole, extra=extra)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, text_hash, size, source, source_size, target, copies, taken."""
    sized = docs.select(
        "doc_id",
        "source",
        words_in(F.col("text")).alias("size"),
        F.xxhash64("text").alias("text_hash"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"),
    )
    hist = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(sources, weights, budget, cap)
    kind = docs.schema["source"].dataType.simpleString()
    shape = f"source {kind}, size long, n long, source_size long, target double, whole long, extra long"
    joined = hist.alias("h").join(aims.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")))
    fitted = (
        joined.select("h.source", "h.size", "h.n", "t.source_size", "t.target")
        .groupBy("source")
        .applyInPandas(_fit_source, shape)
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
    )
    rows = (
        sized.alias("d")
        .join(fitted.hint("rebalance").alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.size") == F.col("f.size")))
        .select("d.*", "f.source_size", "f.target", "f.whole", "f.extra", "f.n", "f.buckets")
        .withColumn("bucket", F.pmod("draw", "buckets"))
    )
    chosen = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    # One row per bucket: documents of the buckets before it, so only the bucket on the border has to be ranked.
    counts = rows.where(chosen).groupBy("source", "size", "bucket", "extra").agg(F.count("*").alias("here"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    borders = counts.withColumn("open", F.col("extra") - F.coalesce(F.sum("here").over(before), F.lit(0)))
    marked = (
        rows.alias("r")
        .join(
            borders.hint("rebalance").alias("b"),
            F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.size") == F.col("b.size")) & (F.col("r.bucket") == F.col("b.bucket")),
            "left",
        )
        .select("r.*", "b.open", "b.here")
        .withColumn("border", (F.col("open") > 0) & (F.col("open") < F.col("here")))
    )
    clear = marked.where(~F.coalesce("border", F.lit(False))).withColumn(
        "more", F.when(F.col("extra") >= F.col("n"), F.col("extra") > 0).otherwise(F.coalesce(F.col("open") >= F.col("here"), F.lit(False)))
    )
    ranked = Window.partitionBy("source", "size", "bucket").orderBy("draw", "doc_id")
    border = marked.where("border").withColumn("more", F.row_number().over(ranked) <= F.col("open"))
    return clear.unionByName(border).select(
        "doc_id",
        "text_hash",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("whole") + F.col("more").cast("long")).alias("copies"),
        (F.col("size") * (F.col("whole") + F.col("more").cast("long"))).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as many times as it is taken. Documents of size 0 carry no words and go."""
    chosen = mix(docs, **options).groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    keyed = docs.where(F.length("text") > 0).select(whole_row(docs).alias("_row"), "doc_id", F.xxhash64("text").alias("_hash")).alias("d")
    joined = keyed.join(chosen.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("_hash") == F.col("c.text_hash")))
    # Equal rows become one with a count before they are moved; those that differ in other columns take turns.
    rows = joined.select("_row", F.col("d.doc_id").alias("_id"), "_hash", F.xxhash64("_row").alias("_kind"), "_copies", "_rows")
    kinds = rows.groupBy("_id", "_hash", "_kind").agg(F.first("_row").alias("_row"), F.count("*").alias("_n"), F.max("_copies").alias("_copies"), F.max("_rows").alias("_rows"))
    turn = Window.partitionBy("_id", "_hash").orderBy("_kind").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(turn), F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_copies") % F.col("_rows") - before))
    repeated = kinds.withColumn("_mine", F.col("_n") * F.floor(F.col("_copies") / F.col("_rows")) + rest).where("_mine > 0")
    return repeated.withColumn("_copy", F.explode(F.expr("sequence(1, _mine)"))).select(*row_columns(docs, "_row"))
