"""Language identification by language-bitmask n-gram filters.

Byte 5-grams of words (lower-cased, blanks and marks as one border sign) are counted per language over all training
rows. A gram belongs to a language that holds it at least twice, unless another language holds it ``contrast`` times as
often, relative to all its grams. The grams fill bit-sliced Bloom filters: a table of masks with a bit per language
(a 64-bit word for each 64 languages), so one look-up of k slots and one AND return all languages that contain a gram. Of
each text the hits per language are counted, corrected for the filters' false positives (the k-th power of each language's
fill), and the language with the most decides; the score is its corrected share of the text's grams.

The number of slots (2**SLOT_BITS at least) follows the grams of the largest language, so that no fill passes MOST_FILL. A
table beyond PART_WORDS words (or 2**SLOT_BITS slots) is dealt into parts by a hash of the gram: each part is broadcast by itself and adds its hits to
the rows, which are written between the parts. So no broadcast grows with the corpus, only with the number of languages.

Edges: NULL texts and texts without a letter are ``und`` with score 0, so are all texts if nothing was learned; ties go
to the smaller language name; repeated rows count as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lilt.llm.common import SMALL_BATCHES, byte_slices, free_encoders, mix, row_columns, whole_row
from lilt.session import cut, settings

GRAM = 5
SLOT_BITS = 20
HASHES = 3
#: Largest share of a language's slots that may be set; a gram it doesn't hold then passes with a chance of a quarter at most.
MOST_FILL = 0.5
#: 64-bit words of one filter table (32 MB).
PART_WORDS = 1 << 22
#: Bytes of texts that are cut into grams at once; they take about 130 times as much memory.
SLICE = 1 << 18
#: Grams that a task gathers before it sums them up.
COUNTED_GRAMS = 1_000_000
UNKNOWN = "und"
_SPREAD = mix(np.arange(11, 11 + GRAM, dtype=np.uint64)) | np.uint64(1)
_SALTS = mix(np.arange(101, 102 + HASHES, dtype=np.uint64))
#: Border sign of all ASCII bytes but letters; letters in lower case; bytes of other letters as they are.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint64)


def gram_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of each row, and their rows; runs of border signs count as one, grams stay inside their row."""
    folded = _FOLD[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    solid = folded != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    folded, row = folded[keep], row[keep]
    n = len(folded) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        total += (folded[k : k + n] + np.uint64(1)) * _SPREAD[k]
    whole = row[:n] == row[GRAM - 1 :]
    return mix(total[whole]), row[:n][whole]


def slots(hashes: np.ndarray, bits: int = SLOT_BITS) -> list[np.ndarray]:
    """The k slots of each hash."""
    low = np.uint64((1 << bits) - 1)
    if bits <= SLOT_BITS:
        return [((hashes >> np.uint64(k * SLOT_BITS)) & low).astype(np.int64) for k in range(HASHES)]
    return [(mix(hashes ^ _SALTS[k]) & low).astype(np.int64) for k in range(HASHES)]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(hashes ^ _SALTS[HASHES]) % np.uint64(parts)).astype(np.int64)


def _padded(texts: pa.Array) -> pa.Array:
    """A border sign on both sides, so that short texts have grams as well."""
    border = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(border, texts.cast(pa.large_string()), border, pa.scalar("", pa.large_string()))


def _padded_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``byte_slices`` of the padded texts; only the texts of one slice are copied at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        for _, _, data, offsets in byte_slices(_padded(texts.slice(first, end - first))):
            yield first, min(end, len(texts)), data, offsets
        first = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, gram, n) of each batch."""
    free_encoders()
    for batch in batches:
        names = batch.column(1).to_pylist()
        order = sorted(set(names))
        known = {name: k for k, name in enumerate(order)}
        code = np.array([known[x] for x in names], dtype=np.uint64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for first, _, data, offsets in _padded_slices(batch.column(0)):
            hashes, row = gram_hashes(data, offsets)
            # The upper 58 bits of a hash and the language's number among its 64 share one word.
            mine = code[first + row]
            parts.append((hashes & ~np.uint64(63) | mine & np.uint64(63), mine >> np.uint64(6)))
            if sum(len(x) for x, _ in parts) > COUNTED_GRAMS:
                yield from _by_64(parts, order)
                parts = []
        if parts:
            yield from _by_64(parts, order)


def _by_64(parts: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    if len(names) <= 64:
        yield _summed([packed for packed, _ in parts], names)
        return
    packed, group = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(group, kind="stable")
    packed, group = packed[order], group[order]
    for g in np.unique(group).tolist():
        a, z = np.searchsorted(group, g, "left"), np.searchsorted(group, g, "right")
        yield _summed([packed[a:z]], names[64 * g : 64 * g + 64])


def _summed(parts: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    packed, n = np.unique(np.concatenate(parts), return_counts=True)
    language = pa.array(names).take(pa.array((packed & np.uint64(63)).astype(np.int64)))
    return pa.RecordBatch.from_arrays([language, pa.array((packed >> np.uint64(6)).astype(np.int64)), pa.array(n)], names=["language", "gram", "n"])


class Filters:
    """The masks, and per language the chance that a gram it doesn't contain passes."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks.reshape(max(1, -(-len(languages) // 64)), -1)
        self.bits = self.masks.shape[1].bit_length() - 1
        one = np.uint64(1)
        # The last slots of a hash of 58 bits reach only so far in a table of 2**SLOT_BITS.
        reach = [self.bits if self.bits > SLOT_BITS else min(self.bits, 58 - k * SLOT_BITS) for k in range(HASHES)]
        fill = lambda k, bits: float(((self.masks[k // 64, : 1 << bits] >> np.uint64(k % 64)) & one).mean())
        self.chance = [math.prod(fill(k, bits) for bits in reach) for k in range(len(languages))]

    def hits(self, hashes: np.ndarray, row: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Per language, the grams of each of the ``n`` rows that pass."""
        at = slots(hashes, self.bits)
        for word in range(len(self.masks)):
            found = self.masks[word][at[0]]
            for more in at[1:]:
                found = found & self.masks[word][more]
            any_bit = int(np.bitwise_or.reduce(found)) if len(found) else 0
            for k in range(64 * word, min(len(self.languages), 64 * word + 64)):
                bit = np.uint64(k % 64)
                if any_bit >> int(bit) & 1:
                    yield np.bincount(row, weights=((found >> bit) & np.uint64(1)).astype(np.float64), minlength=n)
                else:
                    yield np.zeros(n)


class Learned:
    """The grams of the languages as a written table, its size, and the filters of each part of it."""

    def __init__(self, languages: list[str], held: DataFrame | None = None, bits: int = SLOT_BITS, parts: int = 1):
        self.languages, self.held, self.bits, self.parts = languages, held, bits, parts

    def filters(self, part: int) -> Filters:
        words, bits, parts = max(1, -(-len(self.languages) // 64)), self.bits, self.parts
        masks = np.zeros((words, 1 << bits), dtype=np.uint64)
        if self.held is not None:

            def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    gram, number = (batch.column(c).to_numpy() for c in range(2))
                    hashes = gram.view(np.uint64)
                    mine = part_of(hashes, parts) == part
                    hashes, number = hashes[mine], number[mine]
                    place = np.concatenate(slots(hashes, bits)) + np.tile(number >> 6 << bits, HASHES)
                    mask = np.tile(np.uint64(1) << (number & 63).astype(np.uint64), HASHES).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(mask)], names=["slot", "mask"])

            table = self.held.mapInArrow(placed, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
            masks.reshape(-1)[table["slot"].to_numpy(dtype=np.int64)] = table["mask"].to_numpy(dtype=np.int64).view(np.uint64)
        return Filters(self.languages, masks)


def table_size(languages: int, grams: int, part_words: int = PART_WORDS, least_bits: int = SLOT_BITS) -> tuple[int, int]:
    """(bits of a part's slots, parts) for the ``grams`` of the largest language."""
    need = grams * HASHES / -math.log(1 - MOST_FILL)
    words = max(1, -(-languages // 64))
    bits = max(least_bits, math.ceil(math.log2(max(2.0, need))))
    most = max(least_bits, (part_words // words).bit_length() - 1)
    # Parts hold about equal numbers of grams, not exactly; a power of two of them leaves the fill where it was.
    return min(bits, most), 1 << max(0, bits - most)


def learn(docs: DataFrame, contrast: float = 4.0, part_words: int = PART_WORDS, least_bits: int = SLOT_BITS) -> Learned:
    """Filters from (text, lang) of all rows given; rows without a language or a text teach nothing."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = rows.mapInArrow(_counted, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    with settings(docs.sparkSession, SMALL_BATCHES):
        counts = cut(counts, "language-counts")
    found = counts.groupBy("language").agg(F.sum("n").alias("total")).orderBy("language").collect()
    if not found:
        return Learned([])
    numbered = docs.sparkSession.createDataFrame([(r.language, k, float(r.total)) for k, r in enumerate(found)], "language string, number int, total double")
    shares = counts.join(F.broadcast(numbered), "language").withColumn("share", F.col("n") / F.col("total"))
    most = F.max("share").over(Window.partitionBy("gram"))
    held = shares.withColumn("most", most).where((F.col("n") >= 2) & (F.col("share") * contrast >= F.col("most")))
    held = cut(held.select("gram", F.col("number").cast("long").alias("number")), "language-grams")
    sizes = {r.number: r["count"] for r in held.groupBy("number").count().collect()}
    bits, parts = table_size(len(found), max(sizes.values(), default=0), part_words, least_bits)
    return Learned([r.language for r in found], held, bits, parts)


def _adding(shared: Broadcast, part: int, parts: int):
    """Function of texts: their grams in this part, and of these the corrected hits per language."""

    def added(texts: pa.Array) -> pa.Array:
        known = shared.value
        n, true = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), len(known.languages)))
        for first, end, data, offsets in _padded_slices(texts):
            hashes, row = gram_hashes(data, offsets)
            hashes = hashes >> np.uint64(6)
            mine = part_of(hashes, parts) == part
            hashes, row = hashes[mine], row[mine]
            count = np.bincount(row, minlength=end - first)
            n[first:end] = count
            for k, hits in enumerate(known.hits(hashes, row, end - first)):
                true[first:end, k] = (hits - count * known.chance[k]) / max(1e-9, 1.0 - known.chance[k])
        bounds = np.arange(len(texts) + 1, dtype=np.int32) * np.int32(true.shape[1])
        return pa.StructArray.from_arrays([pa.array(n), pa.ListArray.from_arrays(pa.array(bounds), pa.array(true.reshape(-1)))], names=["n", "true"])

    return added


def _corrected(docs: DataFrame, learned: Learned) -> DataFrame:
    """(_row, _letters, _found) by several parts: the corrected hits per language are added up part by part."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(whole_row(docs).alias("_row"), letters.alias("_letters"), F.when(letters, F.col("text")).alias("_text"))
    rows = rows.withColumn("_sum", F.lit(None).cast("struct<n:bigint,true:array<double>>"))
    parts, spark = learned.parts, docs.sparkSession
    for part in range(parts):
        shared = spark.sparkContext.broadcast(learned.filters(part))
        rows = rows.withColumn("_more", F.arrow_udf(_adding(shared, part, parts), "n bigint, true array<double>")(F.col("_text")))
        summed = F.struct((F.coalesce("_sum.n", F.lit(0)) + F.col("_more.n")).alias("n"), F.zip_with(F.coalesce("_sum.true", F.transform("_more.true", lambda x: F.lit(0.0))), "_more.true", lambda x, y: x + y).alias("true"))
        rows = cut(rows.withColumn("_sum", summed).drop("_more"), "language-hits")
    # The first language within 1e-9 of the best before it stays, as in one part.
    first = F.struct(F.lit(-1.0).cast("double").alias("v"), F.lit(0).alias("k"), F.lit(0).alias("i"))
    step = lambda a, x: F.struct(F.when(x > a["v"] + 1e-9, x).otherwise(a["v"]).alias("v"), F.when(x > a["v"] + 1e-9, a["i"]).otherwise(a["k"]).alias("k"), (a["i"] + 1).alias("i"))
    top = F.aggregate("_sum.true", first, step)
    names = spark.sparkContext.broadcast(learned.languages)

    @F.pandas_udf("string")
    def name(number: pd.Series) -> pd.Series:
        return pd.Series([names.value[k] for k in number])

    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_top.v") / F.greatest(F.col("_sum.n"), F.lit(1))))
    return rows.withColumn("_top", top).select("_row", "_letters", F.struct(name(F.col("_top.k")).alias("lang_pred"), score.alias("score")).alias("_found"))


def predict(docs: DataFrame, learned: Learned) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score; only the text is looked at."""
    judged = _corrected(docs, learned) if learned.parts > 1 else _judged(docs, learned)
    return judged.select(
        *row_columns(docs, "_row", ("lang_pred", "score")),
        F.when(F.col("_letters"), F.col("_found.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_letters"), F.col("_found.score")).otherwise(0.0).alias("score"),
    )


def _judged(docs: DataFrame, learned: Learned) -> DataFrame:
    """(_row, _letters, _found) by a table of one part."""
    shared = docs.sparkSession.sparkContext.broadcast(learned.filters(0))

    @F.arrow_udf("lang_pred string, score double")
    def scored(texts: pa.Array) -> pa.Array:
        known = shared.value
        names = np.full(len(texts), UNKNOWN, dtype=object)
        scores = np.zeros(len(texts))
        for first, end, data, offsets in _padded_slices(texts):
            hashes, row = gram_hashes(data, offsets)
            n = np.bincount(row, minlength=end - first)
            best, most = np.full(end - first, -1.0), np.zeros(end - first, dtype=np.int64)
            for k, hits in enumerate(known.hits(hashes >> np.uint64(6), row, end - first)):
                true = (hits - n * known.chance[k]) / max(1e-9, 1.0 - known.chance[k])
                better = true > best + 1e-9
                best[better], most[better] = true[better], k
            if known.languages:
                names[first:end] = np.array(known.languages, dtype=object)[most]
                scores[first:end] = np.clip(best / np.maximum(n, 1), 0.0, 1.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(whole_row(docs).alias("_row"), letters.alias("_letters"), scored(F.when(letters, F.col("text"))).alias("_found"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for the test: a fifth, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
