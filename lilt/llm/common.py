"""Helpers that several operators share: hashing of words in Arrow batches, token ids, connected components."""

from __future__ import annotations

import ctypes
import os
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lilt.session import cut, discard

#: White space of words and lines: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
#: Rows go to Python in batches of at most 10,000 and about this many bytes where a written table takes the result; rows of texts
#: or sets have kilobytes each, and the JVM and the worker both hold a batch.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_PLACES: list[np.ndarray] = []


def _places(n: int) -> np.ndarray:
    """Odd factors, one per place in a word, at least n of them."""
    if not _PLACES or len(_PLACES[0]) < n:
        _PLACES[:] = [mix(np.arange(1, max(n, 1024) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)]
    return _PLACES[0]


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; NULL counts as empty. A text above the limit comes alone."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased if ``fold``, in order, and the row of each.

    A word's hash adds up its bytes' values, each times a factor drawn for its place in the word. Powers of one base would
    give equal sums to some regular words of the same length.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[rows] = solid[rows]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    place = np.arange(n, dtype=np.int64)
    place[at[0] :] -= np.repeat(at, np.diff(np.append(at, n)))
    place[~solid] = 0
    if fold:
        data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    value = _BYTES[data] * _places(int(place.max()) + 1)[place]
    value[~solid] = 0
    return mix(np.add.reduceat(value, at)), np.searchsorted(offsets, at, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending in the row: (hashes, row bounds). Fewer words form one shingle, none form none."""
    hashes, row = word_hashes(data, offsets)
    n_rows = len(offsets) - 1
    spread = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    if len(hashes) >= words:
        total = np.zeros(len(hashes) - words + 1, dtype=np.uint64)
        for k in range(words):
            total += hashes[k : k + len(total)] * spread[k]
        whole = row[: len(total)] == row[words - 1 :]
        shingle, owner = mix(total[whole]), row[: len(total)][whole]
    else:
        shingle, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    counts = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))
        few = [
            mix((hashes[begin[r] : begin[r + 1]] * spread[: counts[r]]).sum(keepdims=True, dtype=np.uint64) + np.uint64(int(counts[r])))[0]
            for r in short
        ]
        shingle, owner = np.concatenate((shingle, np.array(few, dtype=np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    fresh = np.ones(len(shingle), dtype=bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[fresh], np.searchsorted(owner[fresh], np.arange(n_rows + 1))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the runs that begin at ``starts``, one run after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _with_room(x: np.ndarray, size: int) -> np.ndarray:
    """``x``, doubled until it has ``size`` places."""
    while len(x) < size:
        x = np.concatenate((x, np.zeros_like(x)))
    return x


#: Parts that may be encoded side by side: a space or line feed, then no character that any of the libraries takes for white space.
_REGULAR = r"^[ \n][^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


#: Bytes of ASCII letters, and of marks that no pre-token joins to the letter before them.
_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123))
_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?", dtype=np.uint8))


def _part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin: at each text, at each space or line feed behind a character that is no white space, and
    at a mark between an ASCII letter and such a blank."""
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[at >= 3] if len(at) else at  # the first bytes stay together
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    blank = (one <= 32) | (one == 127) | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    blank |= ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & (two == 0x81)) | ((three == 0xE3) & (two == 0x80))
    blank |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[at[~blank]] = True
    begins[at[_MARK[one] & _LETTER[two]] - 1] = True
    begins[offsets[:-1]] = True
    begins[len(data)] = False
    return np.flatnonzero(begins)


class TokenIds:
    """Ids of texts by the tokenizers library.

    No pre-token of a byte-level vocabulary reaches from a character that is no white space over a blank behind it, nor from a
    letter over a mark like a comma, so a text's ids are those of its parts, cut there. Each distinct part is encoded once and
    kept, until names and ids take ``keep`` bytes; then those that came again stay. Parts that begin with their only blank are
    encoded side by side: a token that begins with a blank begins the next part. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, keep: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        vocabulary = self.encoder.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[k for token, k in vocabulary.items() if token[:1] in ("\u0120", "\u010a")]] = True
        self.keep = keep
        self.reset()

    def reset(self) -> None:
        self.names = pa.array([], pa.large_string())
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.begin = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)
        self.again = np.zeros(1 << 14, dtype=bool)
        self.used = 0

    def _thin(self) -> None:
        """Keep the parts that came again since they were learned or last kept, or none if these take half of the room."""
        kept = np.flatnonzero(self.again[: len(self.names)])
        names, begin, length = self.names.take(pa.array(kept)), self.begin[kept], self.length[kept]
        used = int(length.sum())
        if 2 * (names.nbytes + 4 * used) > self.keep:
            self.reset()
            return
        flat = self.flat[ranges(begin, length)]
        self.reset()
        self.names, self.used = names, used
        self.flat = _with_room(self.flat, used)
        self.flat[:used] = flat
        self.begin, self.length, self.again = (_with_room(x, len(kept)) for x in (self.begin, self.length, self.again))
        self.begin[: len(kept)] = np.cumsum(length) - length
        self.length[: len(kept)] = length

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, length of each)."""
        ids = [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum())), sizes

    def _apart(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._encode(parts.to_pylist())

    def _side_by_side(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.frombuffer(parts.buffers()[1], dtype=np.int64)[parts.offset : parts.offset + len(parts) + 1]
        flat, _ = self._encode([parts.buffers()[2][bounds[0] : bounds[-1]].to_pybytes().decode()])
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) != len(parts) or starts[0]:  # a vocabulary with other marks of blanks
            return self._apart(parts)
        return flat, np.diff(np.append(starts, len(flat)))

    def _learn(self, names: pa.Array) -> np.ndarray:
        """Encode and keep ``names``; returns their numbers."""
        regular = pc.match_substring_regex(names, _REGULAR)
        mine = regular.to_numpy(zero_copy_only=False)
        number = len(self.names) + np.where(mine, np.count_nonzero(~mine) + np.cumsum(mine), np.cumsum(~mine)) - 1
        apart, beside = names.filter(pc.invert(regular)), names.filter(regular)
        for some, encode in ((apart, self._apart), (beside, self._side_by_side)):
            for k in range(0, len(some), 4000):
                flat, sizes = encode(some.slice(k, 4000))
                at = len(self.names) + k
                self.flat = _with_room(self.flat, self.used + len(flat))
                self.flat[self.used : self.used + len(flat)] = flat
                self.begin, self.length, self.again = (_with_room(x, at + len(sizes)) for x in (self.begin, self.length, self.again))
                self.again[at : at + len(sizes)] = False
                self.begin[at : at + len(sizes)] = self.used + np.cumsum(sizes) - sizes
                self.length[at : at + len(sizes)] = sizes
                self.used += len(flat)
            self.names = pa.concat_arrays([self.names, some])
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds of each text), each text closed by id 0; NULL counts as empty."""
        if self.names.nbytes + 4 * self.used > self.keep:
            self._thin()
        if not len(texts):
            return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = _part_starts(data, offsets)
        bounds = np.append(starts, len(data))
        parts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.names)
        fresh = place.is_null().to_numpy(zero_copy_only=False)
        known = place.fill_null(0).to_numpy().astype(np.int64)
        self.again[known[~fresh]] = True
        if fresh.any():
            known[fresh] = self._learn(coded.dictionary.filter(pa.array(fresh)))
        number = known[coded.indices.to_numpy()]
        lengths = self.length[number]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, offsets[1:])] + np.arange(1, len(texts) + 1)
        out = np.zeros(int(ends[-1]), dtype=np.int32)
        body = np.ones(len(out), dtype=bool)
        body[ends - 1] = False
        out[body] = self.flat[ranges(self.begin[number], lengths)]
        return out, np.concatenate(([0], ends))


def worker_encoder(path: str) -> TokenIds:
    """The encoder of this Python worker. A worker serves many tasks; what a task's own code keeps ends with the task."""
    home = sys.modules.setdefault("lilt_worker_state", types.ModuleType("lilt_worker_state"))
    made = home.__dict__.setdefault("encoders", {})
    if path not in made:
        made[path] = TokenIds(path)
    return made[path]


def free_encoders() -> None:
    """Drop what earlier tasks of this worker kept for encoding; stages that need the memory call it."""
    home = sys.modules.get("lilt_worker_state")
    if home is not None:
        home.__dict__.get("encoders", {}).clear()
    free_memory()


def free_memory() -> None:
    """Give back what the allocators of this worker keep from earlier tasks, as far as they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU C library has it
    if trim is not None:
        trim(0)


def crc32s(values: np.ndarray, bounds: np.ndarray) -> list[int]:
    """CRC-32 of the bytes of each run of ``values``."""
    view = memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else memoryview(b"")
    at = (bounds * values.dtype.itemsize).tolist()
    return [zlib.crc32(view[a:b]) for a, b in zip(at, at[1:])]


def text_slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows whose texts have about ``limit`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        base = size[first - 1] if first else 0
        end = min(batch.num_rows, max(first + 1, int(np.searchsorted(size, base + limit, "right"))))
        yield batch.slice(first, end - first)
        first = end


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per run of ``values``."""
    values = np.ascontiguousarray(values)
    offsets = (bounds * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def whole_row(rows: DataFrame) -> Column:
    """All columns as one value, so that no name of theirs meets a name of an operator; ``row_columns`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns])


def row_columns(rows: DataFrame, row: str, without: tuple[str, ...] = ()) -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in rows.columns if c not in without]


#: A group's rows are ranked in buckets of about this many.
RANK_ROWS = 512


def ranked_in_groups(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with rank (from 0) inside ``group``: by a hash of the ``order`` columns, then by these columns.

    A group is split into buckets by the hash, so no task ranks a whole group, however many rows it holds.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / RANK_ROWS).alias("_buckets"))
    dealt = rows.join(sizes.hint("rebalance"), group).withColumn("_bucket", F.pmod(F.xxhash64(*order), "_buckets"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    ranked = dealt.join(offsets.hint("rebalance"), [group, "_bucket"]).withColumn("rank", F.col("_before") + inside - 1)
    return ranked.drop("_buckets", "_bucket", "_before")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); a component is named by its smallest node.

    Alternates the large-star and small-star steps until the stars no longer change. Each round is written to the
    shared folder. Minima are partly aggregated before the shuffle, and the joins are plain equi-joins that adaptive
    execution may split, so a hub with many neighbours doesn't land in one task.
    """

    def marked(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least.hint("rebalance"), "u")

    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = marked(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = marked(large)
        joined = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        earlier, stars = stars, cut(joined.union(small.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(earlier)
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
