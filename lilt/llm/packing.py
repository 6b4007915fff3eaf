"""Best-two-fit packing of token sequences.

Documents become pieces of at most ``width`` ids; only longer documents are cut, and the remainder comes first. How pieces go
together depends on their lengths alone, so packing works on the number of pieces of each length (``width`` numbers at most).
A bin takes the longest piece left, then again and again the longest that fits. Then its shortest piece is taken out
and, where two pieces left fill the larger gap better, these two take its place. A pattern is used as often as the
counts allow. Pieces are ranked inside their length, in buckets, and look up their sequence and offset by rank.

The driver sees ``width`` counts and makes a table of patterns, whose size depends on ``width`` and not on the corpus.

Edges: NULL and empty texts are the single closing id 0; repeated rows are packed as often as they occur; rows without doc_id are
packed like others; an empty table gives no sequence; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.llm.common import SMALL_BATCHES, blobs, crc32s, free_memory, ranked_in_groups, text_slices, worker_encoder
from lilt.session import cut, settings

WIDTH = 2048
#: Bytes of texts that are encoded at once.
SLICE = 1 << 20


def pieces(docs: DataFrame, path: str, width: int = WIDTH, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all texts; ids are little-endian unsigned 32-bit numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        encoder = worker_encoder(path)
        for batch in batches:
            for part in text_slices(batch, 2, SLICE):
                ids, bounds = encoder.encode(part.column(2))
                sizes = np.diff(bounds)
                counts = -(-sizes // width)
                row = np.repeat(np.arange(part.num_rows), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = (sizes - (counts - 1) * width)[row]
                start = np.where(piece == 0, 0, first + (piece - 1) * width)
                length = np.where(piece == 0, first, width)
                edges, values = np.append(bounds[row] + start, bounds[-1]), ids.astype("<u4")
                crc = pa.array(crc32s(values, edges), pa.int64())
                numbers = [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), crc]
                names = ["doc_id", "no_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), *numbers]
                if keep_ids:
                    columns.append(blobs(values, edges))
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    shape = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    found = keyed.mapInArrow(encode, shape)
    return found.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def patterns(counts: np.ndarray, width: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of all bins for ``counts[length]`` pieces."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, list[int]]] = []

    def longest(most: int) -> int:
        found = np.flatnonzero(left[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    while (top := longest(width)) > 0:
        items, gap = [], width
        while top:
            items.append(top)
            left[top] -= 1
            gap -= top
            top = longest(gap) if gap else 0
        if len(items) > 1 and gap:
            least = items[-1]
            room = gap + least
            have = np.flatnonzero(left[:room])
            if len(have):
                # For each shorter piece the longest partner that still fits; a pair of equal pieces needs two.
                nearest = np.where(left[: room + 1] > 0, np.arange(room + 1), 0)
                nearest = np.maximum.accumulate(nearest)
                partner = nearest[room - have]
                single = (partner == have) & (left[have] < 2)
                partner[single] = nearest[np.maximum(have[single] - 1, 0)]
                total = np.where(partner > 0, have + partner, 0)
                k = int(np.argmax(total))
                if total[k] > least:
                    items[-1:] = sorted((int(have[k]), int(partner[k])), reverse=True)
                    left[least] += 1
                    left[have[k]] -= 1
                    left[partner[k]] -= 1
        used = np.bincount(items, minlength=width + 1)
        need = used > 0
        more = int((left[need] // used[need]).min())
        left[need] -= more * used[need]
        out.append((1 + more, items))
    return out


def placements(found: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """Per pattern and length: which ranks it holds, its first sequence, and the offsets of its slots."""
    rows, sequence, used = [], 0, {}
    for times, items in found:
        offset = 0
        for length in sorted(set(items), reverse=True):
            slots = items.count(length)
            begin = used.get(length, 0)
            used[length] = begin + times * slots
            rows.append((length, begin, slots, sequence, offset))
            offset += slots * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "begin", "slots", "sequence", "offset"]).astype("int64").sort_values(["length", "begin"], ignore_index=True)


def pack(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``rows`` (length and any columns) with sequence_id and offset."""
    with settings(rows.sparkSession, SMALL_BATCHES):
        rows = cut(rows, "pieces")
    counts = np.zeros(width + 1, dtype=np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    table = placements(patterns(counts, width))
    length, begin, slots, sequence, offset = (table[c].to_numpy() for c in table.columns)
    edges = np.searchsorted(length, np.arange(width + 2))

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(), rank.to_numpy()
        at = np.zeros(len(size), dtype=np.int64)
        for one in np.unique(size):
            mine = size == one
            at[mine] = edges[one] + np.searchsorted(begin[edges[one] : edges[one + 1]], rank[mine], "right") - 1
        turn = rank - begin[at]
        return pd.DataFrame({"sequence_id": sequence[at] + turn // slots[at], "offset": offset[at] + turn % slots[at] * size})

    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in rows.columns]
    ranked = ranked_in_groups(rows, "length", keys).withColumn("_at", place("length", "rank"))
    return ranked.select(*rows.columns, "_at.sequence_id", "_at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, at most ``width`` ids each; needs pieces with ids."""
    part = F.struct("offset", "ids")
    joined = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
