"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by the leading bits of a key's hash. A bucket splits on one more bit only while its bytes
exceed the limit, so small buckets keep short prefixes. Bytes per prefix are summed for 16 bits at a time from partial
sums; only the buckets that are still too large after them look at their next 16 bits. The directory is kept
as its buckets, about (all bytes / limit) rows, and joined to the keys by prefix.

Edges: NULL texts weigh 0 bytes, a NULL key is hashed as the word "null"; an empty table has no shards. Rows of one key
share all 48 bits: if they alone exceed the limit (repeated rows, or one text above it) they stay together in a shard that is
marked ``oversized``. Further columns are kept, except those named like the operator's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lilt.llm.common import row_columns, whole_row
from lilt.session import cut

STEP, BITS = 16, 48


def hash_bits(key: str) -> Column:
    """Leading 48 bits of the key's MD5 as a string of 0 and 1; the same in any engine."""
    head = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, BITS // 4)
    return F.lpad(F.conv(head, 16, 2), BITS, "0")


def leaves(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """(prefix, depth, shard_bytes, shard_rows, oversized) of the buckets of (bits, bytes) rows."""
    cells = cut(rows.groupBy("bits").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "shard-cells")
    found, open_prefixes = [], None
    for low in range(0, BITS, STEP):
        mine = cells.withColumn("start", F.substring("bits", 1, low))
        if open_prefixes is not None:
            mine = mine.join(open_prefixes, "start", "left_semi")
        steps = mine.groupBy("start", F.substring("bits", 1, low + STEP).alias("end")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        depths = F.sequence(F.lit(low + (low > 0)), F.lit(low + STEP))
        sums = (
            steps.withColumn("depth", F.explode(depths))
            .withColumn("prefix", F.expr("substring(end, 1, depth)"))
            .groupBy("depth", "prefix")
            .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        )
        above = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("bytes").alias("parent_bytes"))
        split = (
            sums.withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
            .join(above, ["depth", "parent"], "left")
            .where((F.col("parent_bytes") > limit_bytes) | F.col("parent_bytes").isNull())
        )
        split = cut(split.select("prefix", "depth", "bytes", "n"), "shard-splits")
        last = low + STEP == BITS
        found.append(split.where((F.col("bytes") <= limit_bytes) | (F.lit(last) & (F.col("depth") == BITS))))
        open_prefixes = split.where((F.col("bytes") > limit_bytes) & (F.col("depth") == low + STEP)).select(F.col("prefix").alias("start"))
        if last or open_prefixes.isEmpty():
            break
    return reduce(DataFrame.union, found).select(
        "prefix", "depth", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"), (F.col("bytes") > limit_bytes).alias("oversized")
    )


def shard(docs: DataFrame, limit_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shard (its hash prefix), shard_depth, row_bytes, shard_bytes, shard_rows and oversized."""
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    sized = docs.select(whole_row(docs).alias("_row"), hash_bits(key).alias("_bits"), size.alias("row_bytes"))
    buckets = leaves(sized.select(F.col("_bits").alias("bits"), F.col("row_bytes").alias("bytes")), limit_bytes)
    buckets = cut(buckets, "shard-leaves")
    depths = [r.depth for r in buckets.select("depth").distinct().orderBy("depth").collect()]
    # Keys, not rows, look for their bucket: the rows with their texts are moved once.
    prefixes = F.array(*[F.substring("_bits", 1, d) for d in depths]) if depths else F.array().cast("array<string>")
    keys = sized.select("_bits").distinct().withColumn("_prefix", F.explode(prefixes))
    placed = keys.join(buckets, F.col("_prefix") == F.col("prefix")).select(
        "_bits", F.col("prefix").alias("_shard"), F.struct("depth", "shard_bytes", "shard_rows", "oversized").alias("_leaf")
    )
    return sized.join(placed.hint("rebalance"), "_bits").select(
        *row_columns(docs, "_row", ("shard", "shard_depth", "row_bytes", "shard_bytes", "shard_rows", "oversized")),
        F.col("_shard").alias("shard"),
        F.col("_leaf.depth").alias("shard_depth"),
        "row_bytes",
        F.col("_leaf.shard_bytes").alias("shard_bytes"),
        F.col("_leaf.shard_rows").alias("shard_rows"),
        F.col("_leaf.oversized").alias("oversized"),
    )
