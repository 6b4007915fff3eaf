"""Line dedup: every line key stays in the document with the smallest id that holds it and leaves all others.

One row per line that is long enough: 96 bits of hash, document, position. The rows are range-partitioned by hash,
document and position and sorted so, hence a line that fills a third of the corpus spreads over as many partitions as it
needs. Each partition is streamed once; the first document of a hash is the first row met. A hash that reaches over a
partition's border is settled by two rows per partition, its first and last hash. What comes back is, for each
document that loses lines, a deflated bitmap of kept lines, not text.

Edges: NULL and empty texts are one empty line; lines repeated inside the first document stay; rows without doc_id keep
all lines and are no first holder; repeated rows get equal bitmaps; an empty table gives no bitmaps; further columns of
the documents are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lilt.llm.common import whole_row
from lilt.session import cut

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of lines whose key has at least ``min_chars`` code points."""
    lines = docs.where("doc_id IS NOT NULL AND length(text) >= %d" % min_chars).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    key = F.translate(F.btrim("line", F.lit(BLANK)), UPPER, UPPER.lower())
    return (
        lines.select("doc_id", "text_hash", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc_id", "text_hash", "pos")
    )


LATE, EDGE, HEAD = 0, 1, 2
_STREAMED = "kind int, h1 long, h2 int, doc_id long, text_hash long, pos int"


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted partition. LATE: rows after their hash's first document. EDGE: rows of the partition's first hash, whose
    first document may be in an earlier partition. HEAD: first document, here, of the partition's first and last hash."""
    low: tuple[int, int] | None = None
    last: tuple[int, int, int] | None = None
    for rows in batches:
        if not len(rows):
            continue
        h1, h2, doc = (rows[c].to_numpy() for c in ("h1", "h2", "doc_id"))
        if low is None:
            low = (int(h1[0]), int(h2[0]))
            yield rows.head(1).assign(kind=HEAD)
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        begin = np.flatnonzero(fresh)
        first = np.repeat(doc[begin], np.diff(np.append(begin, len(rows))))
        if last is not None and (h1[0], h2[0]) == last[:2]:
            first[: begin[1] if len(begin) > 1 else len(rows)] = last[2]
        last = (int(h1[-1]), int(h2[-1]), int(first[-1]))
        edge = (h1 == low[0]) & (h2 == low[1])
        kind = np.where(edge, EDGE, LATE)
        keep = edge | (doc > first)
        if keep.any():
            yield rows[keep].assign(kind=kind[keep])
    if last is not None:
        yield pd.DataFrame({"kind": [HEAD], "h1": [last[0]], "h2": [last[1]], "doc_id": [last[2]], "text_hash": [0], "pos": [0]})


def _ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in _STREAMED.split(", ")]
    return (rows[names] for rows in _stream(batches))


def _bitmap(rows: pd.DataFrame) -> pd.DataFrame:
    packed = []
    for positions in rows["dropped"]:
        bits = np.zeros(int(max(positions)) + 1, dtype=np.uint8)
        bits[np.asarray(positions, dtype=np.int64)] = 1
        packed.append(zlib.compress(np.packbits(bits).tobytes(), 6))
    return rows.assign(dropped_bits=packed)[["doc_id", "text_hash", "n_dropped", "dropped_bits"]]


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_dropped, dropped_bits) of documents that lose lines. In the deflated bitmap a set bit is a lost
    line; all other lines, also those behind its end, are kept."""
    key = ("h1", "h2", "doc_id", "pos")
    streamed = cut(
        line_keys(docs, min_chars).repartitionByRange(*key).sortWithinPartitions(*key).mapInPandas(_ordered, _STREAMED), "lines"
    )
    heads = streamed.where(F.col("kind") == HEAD).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    # Heads are two rows per partition of the sort at most, so the edges, which may be one line all over, need no shuffle.
    edges = streamed.where(F.col("kind") == EDGE).join(F.broadcast(heads), ["h1", "h2"]).where("doc_id > first")
    columns = ("doc_id", "text_hash", "pos")
    dropped = streamed.where(F.col("kind") == LATE).select(*columns).union(edges.select(*columns))
    return (
        dropped.groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("dropped"))
        .withColumn("n_dropped", F.size("dropped").cast("long"))
        .mapInPandas(lambda batches: map(_bitmap, batches), "doc_id long, text_hash long, n_dropped long, dropped_bits binary")
    )


@F.pandas_udf(StringType())
def _kept(text: pd.Series, bits: pd.Series) -> pd.Series:
    out = []
    for one, packed in zip(text, bits):
        if packed is None:
            out.append(None)
            continue
        lost = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8))
        out.append("\n".join(line for k, line in enumerate(one.split("\n")) if k >= len(lost) or not lost[k]))
    return pd.Series(out, dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the kept lines as text, then n_lines and n_dropped."""
    keyed = docs.select(whole_row(docs).alias("_row"), "doc_id", F.xxhash64("text").alias("_hash")).alias("d")
    joined = keyed.join(bitmaps.alias("b"), (F.col("d.doc_id") == F.col("b.doc_id")) & (F.col("d._hash") == F.col("b.text_hash")), "left")
    text, lost = F.coalesce(F.col("_row.text"), F.lit("")), F.col("b.dropped_bits")
    kept = F.when(lost.isNull(), text).otherwise(_kept(F.when(lost.isNotNull(), text), lost))
    return joined.select(
        *[kept.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
