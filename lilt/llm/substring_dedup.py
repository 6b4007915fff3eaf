"""Substring dedup: words inside a passage that an earlier document also holds go, found by FM-index and matching statistics.

A window is ``WINDOW`` consecutive words. Documents are streamed against indexes of shards, and shards are made by content so
that a stream meets only the shard that can hold its passage:

1. The anchor of a window is the least hash among its 8-word grams; consecutive windows with one anchor form a segment.
   Equal windows have equal anchors. Grams that a sample of documents shows to be frequent count as greatest, so a frequent
   anchor stands only for windows made of frequent grams alone, and windows on the border of a frequent passage are routed by
   words of their own. The sample only steers the routing; it decides nothing.
2. Segments of an anchor that only one document holds are done. Of the others each distinct content (128 bits of hash and
   its length) is indexed and streamed once, for its smallest document.
3. A shard is all contents of some anchors. A task builds a compressed FM-index of them (``fm_index``) and streams the contents
   through it by backward search. The matching statistic of a place, capped at the window, says where a window of another
   document begins; the index also gives the smallest document that holds it. Words are compared as words here.
4. The found stretches go back to all documents with that content and count where that document is smaller; the
   union of a document's stretches is removed.

An anchor with more contents than ``GROUP_SEGMENTS`` is dealt over several indexes by content, and its contents are streamed
through each of them, batch by batch. A task holds an index of about ``SHARD_WORDS`` words. Reaching the driver: at most
``HOT_GRAMS`` hashes, and two counts.

Edges: NULL and empty texts have no words; texts below a window stay; rows without doc_id keep all words and are no
holder; rows that share a doc_id don't remove each other's words, nor does a passage that repeats inside one document; repeated
rows lose the same words; a text of any length is one slice of a batch and takes about 60 bytes of memory per byte; an
empty table gives an empty result; further columns stay as they are, but for those named n_words and n_removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.llm.common import WORD, byte_slices, mix, ranges, text_slices, whole_row, word_hashes
from lilt.llm.fm_index import NOBODY, FmIndex
from lilt.session import cut

WINDOW = 50
GRAM = 8
#: Windows of a segment at most; its hashes hold for sequences below 128 words.
SEGMENT = 64
#: One in so many documents is sampled for frequent grams; frequent is what so many of them hold.
SAMPLE_ONE_IN = 64
SAMPLE_HOLDERS = 16
HOT_GRAMS = 1_000_000
SHARD_WORDS = 1 << 19
GROUP_SEGMENTS = 8192

_WORDS = re.compile(WORD)
_SEGMENTS = "anchor long, c1 long, c2 long, n int, doc_id long, text_hash long, start int"
_KEY = ["anchor", "c1", "c2", "n"]
_HOT = np.uint64(1 << 63)
_SPREAD = mix(np.arange(1, GRAM + 1, dtype=np.uint64)) | np.uint64(1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def gram_hashes(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(max(0, len(hashes) - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        total += hashes[k : k + len(total)] * _SPREAD[k]
    return mix(total) >> np.uint64(1)


def _power(base: int, n: int) -> np.ndarray:
    steps = np.full(n, np.uint64(base), dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def contents(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of the words from ``begin`` to ``end``."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        value = mix(hashes ^ np.uint64(base)) * _power(base, len(hashes))
        running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(value, dtype=np.uint64)))
        out.append(mix((running[end] - running[begin]) * _power(pow(base, -1, 1 << 64), len(hashes))[begin]).view(np.int64))
    return out[0], out[1]


def _segments(hot: np.ndarray):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in byte_slices(batch.column(2)):
                hashes, row = word_hashes(data, offsets, fold=False)
                n = len(hashes) - WINDOW + 1
                if n <= 0:
                    continue
                grams = gram_hashes(hashes)
                if len(hot):
                    near = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                    grams = np.where(hot[near] == grams, grams | _HOT, grams)
                anchor = sliding_least(grams, WINDOW - GRAM + 1)
                whole = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
                if not len(whole):
                    continue
                anchor, owner = anchor[whole], row[whole]
                fresh = np.ones(len(whole), dtype=bool)
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
                run = np.flatnonzero(fresh)
                place = np.arange(len(whole)) - np.repeat(run, np.diff(np.append(run, len(whole))))
                begin = np.flatnonzero(place % SEGMENT == 0)
                count = np.diff(np.append(begin, len(whole)))
                start, owner = whole[begin], owner[begin]
                c1, c2 = contents(hashes, start, start + count + WINDOW - 1)
                head = np.searchsorted(row, owner)  # first word of the document
                rows = pa.array(first + owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[begin].view(np.int64)), pa.array(c1), pa.array(c2), pa.array(count.astype(np.int32)),
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array((start - head).astype(np.int32)),
                    ],
                    names=[part.split()[0] for part in _SEGMENTS.split(", ")],
                )

    return one


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in byte_slices(batch.column(0)):
            hashes, row = word_hashes(data, offsets, fold=False)
            grams = gram_hashes(hashes)
            whole = np.flatnonzero(row[: len(grams)] == row[GRAM - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
            if len(whole):
                pairs = np.unique(np.stack((row[whole].astype(np.uint64), grams[whole])), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].astype(np.int64))], names=["gram"])


def frequent_grams(docs: DataFrame, one_in: int = SAMPLE_ONE_IN, holders: int = SAMPLE_HOLDERS) -> np.ndarray:
    """Hashes of grams that at least ``holders`` of the sampled documents hold, the ``HOT_GRAMS`` most frequent at most."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text")
    counted = sample.mapInArrow(_distinct_grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= holders)
    rows = counted.orderBy(F.col("n").desc(), "gram").limit(HOT_GRAMS).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy(dtype=np.int64).astype(np.uint64))


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (text, wanted) to one row per wanted segment with its words."""
    for batch in batches:
        for part in text_slices(batch, 0):
            out, words_out = [], []
            wanted = part.column(1)
            flat, bounds = wanted.flatten(), wanted.offsets.to_numpy()
            bounds = bounds - bounds[0]
            starts, counts = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            for k in range(part.num_rows):
                words = _WORDS.findall(part.column(0)[k].as_py())
                for j in range(bounds[k], bounds[k + 1]):
                    out.append(j)
                    words_out.append(" ".join(words[starts[j] : starts[j] + counts[j] + WINDOW - 1]))
            rows = flat.take(pa.array(out, type=pa.int64()))
            names = [*_KEY, "doc_id", "blocks"]
            yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in names), pa.array(words_out, type=pa.string())], names=[*names, "words"])


_STRETCHES = "anchor long, c1 long, c2 long, n int, first array<long>, length array<int>, place array<int>"


def _stretches(rows: pa.Table, index: FmIndex, names: pa.Array) -> pa.RecordBatch | None:
    """For each content the runs of windows that a document holds, with the smallest such document."""
    symbols, bounds = _numbers(rows.column("words"), names)
    found = index.first_owners(symbols, bounds)
    own = np.repeat(rows.column("doc_id").to_numpy(), np.diff(bounds))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # Other documents with this content may lose what its first holder keeps, so its own places count as well.
    held = np.flatnonzero((found != NOBODY) & ((found < own) | np.repeat(rows.column("several").to_numpy(), np.diff(bounds))))
    if not len(held):
        return None
    fresh = np.ones(len(held), dtype=bool)
    fresh[1:] = (held[1:] != held[:-1] + 1) | (owner[held[1:]] != owner[held[:-1]]) | (found[held[1:]] != found[held[:-1]])
    begin = np.flatnonzero(fresh)
    length = np.diff(np.append(begin, len(held)))
    content = owner[held[begin]]
    used, at = np.unique(content, return_index=True)
    offsets = pa.array(np.append(at, len(begin)).astype(np.int32))
    lists = [
        pa.ListArray.from_arrays(offsets, pa.array(values))
        for values in (found[held[begin]], length.astype(np.int32), (held[begin] - bounds[content]).astype(np.int32))
    ]
    keys = rows.select(_KEY).take(pa.array(used)).combine_chunks()
    columns = [keys.column(c).combine_chunks() for c in _KEY]
    return pa.RecordBatch.from_arrays([*columns, *lists], names=[part.split()[0] for part in _STRETCHES.split(", ")])


def _numbers(words: pa.ChunkedArray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers from 1, 0 for a word not in ``names``; bounds of the rows)."""
    lists = pc.split_pattern(words.combine_chunks().cast(pa.large_string()), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    number = pc.fill_null(pc.index_in(coded.dictionary, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return number[coded.indices.to_numpy()], offsets - offsets[0]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard, sorted by anchor, index and role: contents to index come before those that are only streamed."""
    held: list[pa.RecordBatch] = []
    words, index, names, at = 0, None, None, None

    def built() -> tuple[FmIndex, pa.Array, pa.Table]:
        rows = pa.Table.from_batches(held)
        known = pc.unique(pc.split_pattern(rows.column("words").combine_chunks().cast(pa.large_string()), " ").flatten())
        symbols, bounds = _numbers(rows.column("words"), known)
        return FmIndex(symbols, bounds, rows.column("doc_id").to_numpy(), len(known) + 1, WINDOW), known, rows

    for batch in batches:
        anchor, block = batch.column("anchor").to_numpy(), batch.column("at").to_numpy()
        member, size = batch.column("member").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
        fresh = np.ones(len(anchor), dtype=bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]) | (member[1:] != member[:-1])
        bounds = np.append(np.flatnonzero(fresh), len(anchor))
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            part, group = batch.slice(begin, end - begin), (anchor[begin], block[begin])
            if member[begin]:
                if group != at and (words >= SHARD_WORDS or index is not None):
                    if index is None:
                        index, names, rows = built()
                        found = _stretches(rows, index, names)
                        if found is not None:
                            yield found
                    held, words, index = [], 0, None
                held.append(part)
                words += int(size[begin:end].sum()) + (WINDOW - 1) * (end - begin)
            else:
                if index is None:
                    index, names, rows = built()
                    found = _stretches(rows, index, names)
                    if found is not None:
                        yield found
                found = _stretches(pa.Table.from_batches([part]), index, names)
                if found is not None:
                    yield found
            at = group
    if held and index is None:
        index, names, rows = built()
        found = _stretches(rows, index, names)
        if found is not None:
            yield found


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, stretches): words of a document, from and up to, that a smaller document's windows cover."""
    keyed = docs.where("doc_id IS NOT NULL AND length(text) >= %d" % (2 * WINDOW - 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    segments = cut(keyed.mapInArrow(_segments(frequent_grams(keyed)), _SEGMENTS), "substring-segments")
    holder = F.min(F.struct("doc_id", "text_hash", "start")).alias("holder")
    distinct = segments.groupBy(*_KEY).agg(holder, F.max("doc_id").alias("last"))
    held = distinct.groupBy("anchor").agg(F.min("holder.doc_id").alias("low"), F.max("last").alias("high"), F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / GROUP_SEGMENTS).cast("int").alias("blocks")
    shared = cut(distinct.join(held.where("low < high").select("anchor", blocks), "anchor"), "substring-contents")
    several = F.col("last") > F.col("holder.doc_id")
    wanted = F.struct(*_KEY, F.col("holder.start").alias("start"), F.col("holder.doc_id").alias("doc_id"), "blocks")
    asked = shared.groupBy("holder.doc_id", "holder.text_hash").agg(F.collect_list(wanted).alias("wanted"))
    met = keyed.join(asked, ["doc_id", "text_hash"]).select("text", "wanted")
    texts = cut(met.mapInArrow(_fetched, "anchor long, c1 long, c2 long, n int, doc_id long, blocks int, words string"), "substring-texts")
    # Repeated rows fetch a content twice, which changes nothing.
    marked = texts.join(shared.select(*_KEY, several.alias("several")), _KEY)
    own = F.pmod(F.col("c1"), F.col("blocks")).cast("int")
    dealt = marked.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("member", own == F.col("at"))
    total = shared.agg(F.sum(F.col("n") + (WINDOW - 1))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    columns = [*_KEY, "doc_id", "several", "at", "member", "words"]
    sharded = dealt.select(*columns).repartition(shards, "anchor", "at").sortWithinPartitions("anchor", "at", F.col("member").desc())
    found = cut(sharded.mapInArrow(_search, _STRETCHES), "substring-found")
    pieces = segments.join(found, _KEY).select(
        "doc_id", "text_hash", "start", F.explode(F.arrays_zip("first", "length", "place")).alias("s")
    ).where("s.first < doc_id")
    begin = (F.col("start") + F.col("s.place")).alias("from")
    return pieces.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct(begin, (begin + F.col("s.length") + (WINDOW - 1)).alias("until")))).alias("stretches")
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, stretches) to the row, kept words, their count before and the number removed."""
    for batch in batches:
        for part in text_slices(batch, 1):
            stretches = part.column(2)
            flat, bounds = stretches.flatten(), stretches.offsets.to_numpy()
            bounds = bounds - bounds[0]
            begin, until = flat.field("from").to_numpy(), flat.field("until").to_numpy()
            lost = ~np.asarray(stretches.is_null())
            texts, counts, removed = [], [], []
            for k, text in enumerate(part.column(1).to_pylist()):
                words = _WORDS.findall(text or "")
                counts.append(len(words))
                gone = 0
                if lost[k]:
                    mask = np.zeros(len(words), dtype=bool)
                    spans = slice(bounds[k], bounds[k + 1])
                    mask[ranges(begin[spans].astype(np.int64), until[spans] - begin[spans])] = True
                    words = [words[j] for j in np.flatnonzero(~mask).tolist()]
                    gone = int(mask.sum())
                removed.append(gone)
                texts.append(" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, type=pa.string()), pa.array(counts, type=pa.int64()), pa.array(removed, type=pa.int64())],
                names=["_row", "_kept", "n_words", "n_removed"],
            )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the kept words, joined by single spaces, as text, then n_words and n_removed."""
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    row = whole_row(docs.select(*[f"`{c}`" for c in rest])) if rest else F.lit(None)
    keyed = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))
    lost = repeated_stretches(docs.select("doc_id", "text"))
    joined = keyed.alias("d").join(lost.alias("l"), (F.col("_doc") == F.col("l.doc_id")) & (F.col("_hash") == F.col("l.text_hash")), "left")
    shape = f"_row {keyed.schema['_row'].dataType.simpleString()}, _kept string, n_words long, n_removed long"
    out = joined.select("_row", "_text", "stretches").mapInArrow(_kept, shape)
    return out.select(*[F.col("_kept").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c in [*rest, "text"]], "n_words", "n_removed")
