"""Token ids as canonical length-limited Huffman blocks, and back.

All texts are encoded once. Ids are counted over the whole corpus; package-merge gives code lengths of at most 16 bits (or
one more than the vocabulary needs), and the canonical code follows from the lengths alone. Documents are range-partitioned
by id; each partition writes blocks of whole documents, about 262,144 ids each. A block can be read on its own: it
holds its bits, a checkpoint (bit offset) for every 128 ids, and the ids and lengths of its documents. Decoding looks up
16 bits at a time in one table and walks all checkpoints of a block side by side.

A written corpus is a folder with the tables ``codebook`` (id, bits) and ``blocks``. Only the counts per id and one number per
partition reach the driver.

Edges: NULL and empty texts are the single closing id 0; rows without doc_id come first; repeated rows are written as often
as they occur; an empty table gives a folder without blocks; a document above the block size is a block of its own; further
columns are not written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lilt.llm.common import blobs, crc32s, text_slices, worker_encoder
from lilt.session import cut, shared_dir

BLOCK_IDS = 1 << 18
STEP = 128
LEAST_BITS = 16
_FIRST = -(2**63)


def id_type(path: str) -> str:
    """Ids take 16 bits where the vocabulary allows."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, no_id, tie, ids): ids of each text, closed by 0, as little-endian numbers of ``id_type``."""
    kind = id_type(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            for part in text_slices(batch, 3):
                ids, bounds = encoder.encode(part.column(3))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], blobs(ids.astype(kind), bounds)], names=["doc_id", "no_id", "tie", "ids"])

    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc_id"),
        F.col("doc_id").isNull().alias("no_id"),
        F.xxhash64("text").alias("tie"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return keyed.mapInArrow(encode, "doc_id long, no_id boolean, tie long, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> dict[int, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            bounds = np.frombuffer(batch.column(0).buffers()[1], dtype=np.int32)[batch.column(0).offset :][: batch.num_rows + 1]
            if not batch.num_rows or bounds[0] == bounds[-1]:
                continue
            found = np.bincount(np.frombuffer(batch.column(0).buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]].view(kind))
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in rows}


def code_lengths(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids ascending, code lengths) by package-merge under the length limit."""
    ids = np.array(sorted(counts), dtype=np.int64)
    if len(ids) <= 1:
        return ids, np.ones(len(ids), dtype=np.int64)
    limit = max(LEAST_BITS, int(len(ids) - 1).bit_length() + 1)
    weights = np.array([counts[i] for i in ids.tolist()], dtype=np.float64)
    order = np.argsort(weights, kind="stable")
    leaves = weights[order]
    leaf_marks, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate((leaves, packages))
        sort = np.argsort(merged, kind="stable")
        merged = merged[sort]
        leaf_marks.append(sort < len(leaves))
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    depth, wanted = np.zeros(len(ids), dtype=np.int64), 2 * len(ids) - 2
    for marks in reversed(leaf_marks):
        taken = int(marks[:wanted].sum())
        depth[order[:taken]] += 1
        wanted = 2 * (wanted - taken)
    return ids, depth


class Code:
    """Canonical code of (ids, lengths): codes for writing, one look-up table for reading."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.bits = max(LEAST_BITS, int(lengths.max(initial=1)))
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order].astype(np.int64)
        span = np.int64(1) << (self.bits - lengths)
        first = np.cumsum(span) - span
        size = int(ids.max(initial=0)) + 1
        self.code, self.length = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        self.code[ids] = (first >> (self.bits - lengths)).astype(np.uint64)
        self.length[ids] = lengths
        self.symbol = np.zeros(1 << self.bits, dtype=np.int32)
        self.step = np.ones(1 << self.bits, dtype=np.int64)
        used = int(span.sum())
        self.symbol[:used], self.step[:used] = np.repeat(ids, span), np.repeat(lengths, span)

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every STEP-th id)."""
        length = self.length[ids]
        at = np.cumsum(length) - length
        word, shift = at >> 5, (64 - length - (at & 31)).astype(np.uint64)
        wide = self.code[ids] << shift
        n = int(word[-1]) + 2 if len(ids) else 0
        # Codes don't share bits, so sums of 32-bit halves are exact in doubles.
        words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return words.astype(np.uint64).astype(">u4").tobytes(), at[::STEP]

    def read(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        raw = np.frombuffer(bits + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        out = np.zeros((len(offsets), STEP), dtype=np.int32)
        at, last, cut_to, mask = offsets.astype(np.int64).copy(), len(window) - 1, 32 - self.bits, np.int64((1 << self.bits) - 1)
        for k in range(STEP):
            found = (window[np.minimum(at >> 3, last)].astype(np.int64) >> (cut_to - (at & 7))) & mask
            out[:, k] = self.symbol[found]
            at += self.step[found]
        return out.ravel()[:n]


def write_tokens(docs: DataFrame, path: str, folder: str) -> None:
    """Write all texts of ``docs`` (doc_id, text) to ``folder`` with the tokenizer file at ``path``."""
    spark, kind = docs.sparkSession, id_type(path)
    width = np.dtype(kind).itemsize
    tokens = cut(tokenized(docs, path), "tokens", "zstd")
    ids, lengths = code_lengths(id_counts(tokens, kind))
    code = Code(ids, lengths)

    def block(part: int, start: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc_ids, no_ids, sizes, values = (np.concatenate(x) for x in zip(*held))
        bits, offsets = code.write(values)
        row = [part, start, int(sizes.sum()), doc_ids.tobytes(), no_ids.astype(np.uint8).tobytes(), sizes.tobytes(), offsets.astype(np.int64).tobytes(), bits]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    names = ["part", "start", "n", "doc_ids", "no_ids", "sizes", "checkpoints", "bits"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, start, part = [], 0, 0, 0
        for batch in batches:
            blob = batch.column("ids").cast(pa.large_binary())
            offsets = np.frombuffer(blob.buffers()[1], dtype=np.int64)[blob.offset : blob.offset + len(blob) + 1] // width
            values = np.frombuffer(blob.buffers()[2] or b"", dtype=kind)
            doc_ids, no_ids = batch.column("doc_id").to_numpy(), batch.column("no_id").to_numpy(zero_copy_only=False)
            part, row = batch.column("part")[0].as_py() if len(blob) else part, 0
            while row < len(blob):
                # As many whole rows as still fit; a longer one is a block of its own.
                end = int(np.searchsorted(offsets, offsets[row] + BLOCK_IDS - size, "right")) - 1
                if end <= row and held:
                    yield block(part, start, held)
                    held, start, size = [], start + size, 0
                    continue
                end = max(row + 1, min(end, len(blob)))
                held.append((doc_ids[row:end], no_ids[row:end], np.diff(offsets[row : end + 1]), values[offsets[row] : offsets[end]]))
                size += int(offsets[end] - offsets[row])
                row = end
        if held:
            yield block(part, start, held)

    order = ("doc_id", "no_id", "tie")
    sorted_rows = tokens.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    shape = "part int, start long, n long, doc_ids binary, no_ids binary, sizes binary, checkpoints binary, bits binary"
    sorted_rows.mapInArrow(encode, shape).write.mode("overwrite").parquet(f"{folder}/blocks")
    book = spark.createDataFrame(pd.DataFrame({"id": ids, "bits": lengths}), "id long, bits long")
    book.write.mode("overwrite").parquet(f"{folder}/codebook")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents of a folder; start counts the ids of all documents before.

    ``ids`` are little-endian unsigned 32-bit numbers, ``ids_crc32`` is the CRC-32 of these bytes.
    """
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    code = Code(book["id"].to_numpy(dtype=np.int64), book["bits"].to_numpy(dtype=np.int64))
    blocks = spark.read.parquet(f"{folder}/blocks")
    before, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        before[r.part], total = total, total + r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                long = lambda c: np.frombuffer(row[c].as_buffer(), dtype=np.int64)  # noqa: E731, B023
                ids = code.read(row["bits"].as_py(), long("checkpoints"), row["n"].as_py()).astype("<u4")
                sizes = long("sizes")
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                columns = [
                    pa.array(long("doc_ids")), pa.array(np.frombuffer(row["no_ids"].as_buffer(), dtype=np.uint8).astype(bool)),
                    pa.array(before[row["part"].as_py()] + row["start"].as_py() + bounds[:-1]), pa.array(sizes), pa.array(crc32s(ids, bounds), pa.int64()),
                ]
                if with_ids:
                    columns.append(blobs(ids, bounds))
                names = ["doc_id", "no_id", "start", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    shape = "doc_id long, no_id boolean, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = blocks.mapInArrow(decode, shape)
    return rows.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lilt-{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex[:12]}"
