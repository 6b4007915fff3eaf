"""N-gram Jaccard join by universe-partition pigeonhole.

Two sets of word shingles link when 100 x intersection >= 75 x union; then they differ in at most (a + b) / 7 shingles. Sizes
fall into bands; a scheme covers a band and those larger partners that can still link. For a scheme whose pairs differ in at
most H shingles, a hash splits the universe into H + 1 + E segments. Every document indexes, for each segment, a signature of
its subset (one unit: no such match, at least one difference) and, in D further designated places, the subset's one-deletion
neighbourhood (two units). Among H + 1 units one must match, so E + D units are spare. Empty subsets are paid from them.

Cost-based allocation spends the spare units: signatures held by many sets are hot. A document whose hot segments cost no
more than its spare units leaves them all out; it still meets every partner in a cheap segment. Only documents with more hot
segments than that (near copies in large groups, mostly boilerplate) keep some. Lists fall into classes by the power of two of
their length, and such a document leaves out its hottest classes as far as its spare units pay for them. All documents leave
out from the hottest class down, so what either of two leaves out of their shared units costs at most one's spare units; one
shared unit is left in both. In hot lists all are first held against one leader; after the links so found are merged, only sets
of different components that both kept a hot signature are compared. Their pairs are made on packed arrays, lists with
the same smallest member in the same task, where a pair of many lists becomes one row. Before that, counts of shingles in
cells and 16 bits of each shingle bound what two sets can share, and pairs that can't reach a link are left out.
No list, bucket or partner is capped, and every candidate is verified on the whole sets.

Signatures travel as packed arrays (7 bytes each), grouped by buckets of neighbouring segments, whose number grows with the corpus; equal sets are one
entry. Sets are sent only for documents that are candidates, found by a bit filter of fixed size.

Edges: NULL texts and texts without words have the empty set and link with nothing; 1 to 4 words form one shingle; repeated rows
and copies share a component; rows without doc_id come back with component NULL; rows of one doc_id count as one document;
an empty table gives an empty table; further columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lilt.llm.common import SMALL_BATCHES, byte_slices, components, free_encoders, free_memory, mix, ranges, row_columns, shingle_sets, whole_row
from lilt.session import cut, discard, settings

WORDS = 5
#: Sets of one signature that are compared with each other right away.
PLAIN = 16
BUCKET_SIGNATURES = 500_000
#: Members of hot lists, and rows of pairs, that a task holds at once.
PAIR_MEMBERS = 200_000
PAIR_ROWS = 400_000
FLUSH_SIGNATURES = 500_000
#: Sets of one flush.
MOST_ENTRIES = 20_000
SLICE = 1 << 18
FILTER_BITS = 26
_SALT = np.uint64(0xD6E8FEB86659FD93)


class Schemes:
    """Bands of sizes and their partitions of the universe."""

    def __init__(self) -> None:
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
        self.edges = np.array(edges, dtype=np.int64)
        largest = self.edges[1:] - 1
        must = (largest + largest * 4 // 3) // 7 + 1
        self.designated = 1 + must // 64
        extra = 1 + must * 9 // 20 + 3 * np.sqrt(must).astype(np.int64)  # about as many stay empty in the smallest sets of a band
        self.segments = must + extra
        self.spare = extra + self.designated

    def entries(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, scheme) of every scheme that a set takes part in: its band's, and the one below if a partner can be there."""
        band = np.searchsorted(self.edges, sizes, "right") - 1
        rows = np.flatnonzero(sizes > 0)
        below = rows[(band[rows] > 0) & (3 * sizes[rows] <= 4 * (self.edges[band[rows]] - 1))]
        return np.concatenate((rows, below)), np.concatenate((band[rows], band[below] - 1))


SCHEMES = Schemes()


def fingerprints(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums per set."""
    out = []
    for salt in (np.uint64(0), _SALT):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(shingles ^ salt), dtype=np.uint64)))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def placed_signatures(
    shingles: np.ndarray, bounds: np.ndarray, rows: np.ndarray, scheme: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, entry, designated, segment) of the entries (rows, scheme), and the spare units left to each entry.

    Empty subsets say nothing, so an entry pays for them with spare units and leaves them out; one that can't (-1 units
    left) indexes them and will keep all its hot signatures.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(rows):
        return np.zeros(0, dtype=np.uint64), none, none.astype(bool), none, none
    sizes = np.diff(bounds)[rows]
    token = shingles[ranges(bounds[:-1][rows], sizes)]
    entry = np.repeat(np.arange(len(rows)), sizes)
    segments = SCHEMES.segments[scheme]
    salt = mix((scheme + 1).astype(np.uint64) * _SALT)
    place = (mix(token ^ salt[entry]) % segments[entry].astype(np.uint64)).astype(np.int64)
    base = np.cumsum(segments) - segments
    slot = base[entry] + place
    value = mix(token + salt[entry])
    subset = np.zeros(int(segments.sum()), dtype=np.uint64)
    np.add.at(subset, slot, value)
    owner = np.repeat(np.arange(len(rows)), segments)
    number = np.arange(len(subset)) - base[owner]
    name = mix(salt[owner] + number.astype(np.uint64))
    marked = number < SCHEMES.designated[scheme][owner]
    near = place < SCHEMES.designated[scheme][entry]
    one_less = mix((subset[slot[near]] - value[near]) ^ name[slot[near]])
    held = np.bincount(slot, minlength=len(subset))
    empty, single = held == 0, held[slot[near]] == 1
    paid = np.bincount(owner[empty], 1.0 + marked[empty], len(rows)) + np.bincount(entry[near][single], minlength=len(rows))
    left = SCHEMES.spare[scheme] - paid.astype(np.int64)
    left = np.where(left < 0, -1, left)
    said = np.concatenate((~empty, ~single)) | (left < 0)[np.concatenate((owner, entry[near]))]
    return (
        np.concatenate((mix(subset ^ name), one_less))[said],
        np.concatenate((owner, entry[near]))[said],
        np.concatenate((marked, np.ones(int(near.sum()), dtype=bool)))[said],
        np.concatenate((number, place[near]))[said],
        left,
    )


def signatures(
    shingles: np.ndarray, bounds: np.ndarray, rows: np.ndarray, scheme: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``placed_signatures``, without the segments."""
    sig, entry, marked, _, left = placed_signatures(shingles, bounds, rows, scheme)
    return sig, entry, marked, left


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2) of all rows: set size and fingerprint."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column(1), SLICE):
                shingles, bounds = shingle_sets(data, offsets, WORDS)
                f1, f2 = fingerprints(shingles, bounds)
                columns = [batch.column(0).slice(first, end - first), pa.array(np.diff(bounds)), pa.array(f1), pa.array(f2)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f1", "f2"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(measure, "doc_id long, n long, f1 long, f2 long")


def bucket_bounds(sets: DataFrame) -> np.ndarray:
    """Bounds of the buckets of each scheme, by the number of segments that the rows of ``sets`` (n) have in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, scheme = SCHEMES.entries(batch.column(0).to_numpy())
            found = np.bincount(scheme)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found)), pa.array(found[found > 0])], names=["scheme", "n"])

    held = np.zeros(len(SCHEMES.segments), dtype=np.int64)
    for r in sets.select("n").mapInArrow(count, "scheme long, n long").groupBy("scheme").agg(F.sum("n").alias("n")).collect():
        held[r.scheme] = -(-r.n * int(SCHEMES.segments[r.scheme]) // BUCKET_SIGNATURES)
    return np.concatenate(([0], np.cumsum(held)))


def buckets_of(sig: np.ndarray, scheme: np.ndarray, segment: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bucket of each signature. A scheme's buckets hold runs of its segments, so that a set meets few of them and what
    describes it travels few times; with more buckets than segments, a segment's signatures are dealt by hash."""
    segments, held = SCHEMES.segments[scheme], np.diff(bounds)[scheme]
    first = segment * held // segments
    several = np.maximum((segment + 1) * held // segments - first, 1)
    return bounds[scheme] + first + (sig % several.astype(np.uint64)).astype(np.int64)


def _index(buckets: np.ndarray):
    """Signatures of a partition, equal sets once, packed per bucket."""

    def pack(held: list[tuple], sets: list[tuple], owners: list[int]) -> Iterator[pa.RecordBatch]:
        sig, entry, marked, segment = (np.concatenate(x) for x in zip(*held))
        held.clear()
        print_, size, scheme, left = (np.concatenate(x) for x in zip(*sets))
        doc = np.array(owners, dtype=np.int64)
        bucket = buckets_of(sig, scheme[entry], segment, buckets)
        order = np.argsort(bucket, kind="stable")
        sig, entry, marked, bucket = sig[order] >> np.uint64(25), entry[order], marked[order], bucket[order]
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for a, z in zip(edge[:-1], edge[1:]):
            mine, local = np.unique(entry[a:z], return_inverse=True)
            arrays = (
                (sig[a:z] & np.uint64(0xFFFFFFFF)).astype("<u4"),
                ((sig[a:z] >> np.uint64(32)).astype(np.uint8) << np.uint8(1)) | marked[a:z].astype(np.uint8),
                local.astype("<u2" if len(mine) < 1 << 16 else "<u4"), doc[mine], print_[mine], size[mine].astype(np.int64), scheme[mine].astype(np.uint8), left[mine].astype("<i4"),
            )
            yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names=_PACKED_NAMES)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_encoders()
        held, sets, owners, known, count, entries = [], [], [], {}, 0, 0
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column(1), SLICE):
                shingles, bounds = shingle_sets(data, offsets, WORDS)
                f1, _ = fingerprints(shingles, bounds)
                doc = batch.column(0).slice(first, end - first).to_numpy(zero_copy_only=False)
                rows, scheme = SCHEMES.entries(np.diff(bounds))
                fresh = []
                for k, (row, which) in enumerate(zip(rows.tolist(), scheme.tolist())):
                    at = known.setdefault((f1[row], which), len(owners))
                    if at == len(owners):
                        owners.append(doc[row])
                        fresh.append(k)
                    else:  # equal sets go by their smallest document
                        owners[at] = min(owners[at], doc[row])
                rows, scheme = rows[fresh], scheme[fresh]
                sig, entry, marked, segment, left = placed_signatures(shingles, bounds, rows, scheme)
                held.append((sig, entry + entries, marked, segment))
                sets.append((f1[rows], np.diff(bounds)[rows], scheme, left))
                count, entries = count + len(sig), entries + len(rows)
                if count > FLUSH_SIGNATURES or entries > MOST_ENTRIES:
                    yield from pack(held, sets, owners)
                    held, sets, owners, known, count, entries = [], [], [], {}, 0, 0
        if count:
            yield from pack(held, sets, owners)

    return index


_PACKED_NAMES = ["bucket", "low", "high", "entry", "doc", "print", "size", "scheme", "spare"]
_PACKED = "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED_NAMES[1:])
PAIR, SPENT, LIST = 0, 1, 2
_FOUND = "kind int, a long, b long, scheme int, spare int, other int, n int, members binary, sizes binary"
#: Members of one LIST row; longer lists go on in further rows.
LIST_ROWS = 1 << 16


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: pairs of sets that share a signature few sets hold, and the members of hot signatures."""

    def close(bucket: int, rows: list) -> Iterator[pd.DataFrame]:
        low, high, entry, doc, print_, size, scheme, spare = (list(column) for column in zip(*rows))
        rows.clear()
        docs = [x.size // 8 for x in doc]
        shift = np.cumsum([0, *docs])
        entry = np.concatenate([np.frombuffer(e, "<u2" if n < 1 << 16 else "<u4").astype(np.int32) + np.int32(s) for e, n, s in zip(entry, docs, shift)])
        high = np.concatenate([np.frombuffer(x, np.uint8) for x in high])
        marked = high & 1
        sig = np.concatenate([np.frombuffer(x, "<u4") for x in low]).astype(np.uint64)
        sig |= (high >> 1).astype(np.uint64) << np.uint64(32)
        doc, print_, size = (np.concatenate([np.frombuffer(x, np.int64) for x in column]) for column in (doc, print_, size))
        scheme, spare = np.concatenate([np.frombuffer(x, np.uint8) for x in scheme]), np.concatenate([np.frombuffer(x, "<i4") for x in spare])
        del low, high
        # Equal sets of other partitions: the smallest document stands for all.
        by_set = np.lexsort((doc, size, print_))
        head = np.ones(len(by_set), dtype=bool)
        head[1:] = (print_[by_set][1:] != print_[by_set][:-1]) | (size[by_set][1:] != size[by_set][:-1])
        first = np.zeros(len(doc), dtype=np.int64)
        first[by_set] = doc[by_set][np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.append(head, len(sig)))
        shared = np.repeat(count > 1, count)
        sig, order = sig[shared], order[shared]
        who, flag = first[entry[order]], marked[order]
        kind, measure, units = scheme[entry[order]].astype(np.int64), size[entry[order]], spare[entry[order]]
        again = np.lexsort((1 - flag, who, sig))
        sig, who, flag, kind, measure, units = sig[again], who[again], flag[again], kind[again], measure[again], units[again]
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
        sig, who, flag, kind, measure, units = sig[fresh], who[fresh], flag[fresh], kind[fresh], measure[fresh], units[fresh]
        head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(head, len(sig)))
        plain = np.repeat(count <= PLAIN, count)
        meet = [np.zeros(0, dtype=np.int64)]
        step = [np.zeros(0, dtype=np.int64)]
        at, size_here = np.arange(len(sig)), np.repeat(head + count, count)
        for gap in range(1, PLAIN):
            one = at[plain & (at + gap < size_here)]
            fits = 4 * np.minimum(measure[one], measure[one + gap]) >= 3 * np.maximum(measure[one], measure[one + gap])
            meet.append(one[fits])
            step.append(one[fits] + gap)
        x, y = np.concatenate(meet), np.concatenate(step)
        pairs = pd.DataFrame({"a": who[x], "b": who[y], "scheme": kind[x], "spare": units[x], "other": units[y]})
        if len(pairs):
            counted = pairs.groupby(["a", "b", "scheme", "spare", "other"], as_index=False).size().rename(columns={"size": "n"})
            yield counted.assign(kind=PAIR, members=None, sizes=None)[_FOUND_NAMES]
        hot = ~plain
        if hot.any():
            # What the hot segments of a set cost here, and the members of each hot signature in order of doc_id.
            length = np.repeat(np.frexp(count)[1], count)
            spent = pd.DataFrame({"a": who[hot], "scheme": kind[hot], "spare": units[hot], "n": length[hot], "b": 1 + flag[hot].astype(np.int64)})
            yield spent.groupby(["a", "scheme", "spare", "n"], as_index=False)["b"].sum().assign(kind=SPENT, other=0, members=None, sizes=None)[_FOUND_NAMES]
            many = np.flatnonzero(count > PLAIN)
            begin = np.concatenate([np.arange(head[k], head[k] + count[k], LIST_ROWS) for k in many])
            owner = np.repeat(head[many], -(-count[many] // LIST_ROWS))
            sizes = np.repeat(count[many], -(-count[many] // LIST_ROWS))
            stop = np.minimum(begin + LIST_ROWS, owner + sizes)
            yield pd.DataFrame(
                {
                    "kind": LIST, "a": (sig[begin] * np.uint64(1 << 20) + np.uint64(bucket)).view(np.int64), "b": (sizes > LIST_ROWS).astype(np.int64), "scheme": kind[begin], "spare": 0, "other": 0, "n": np.frexp(sizes)[1],
                    "members": [who[i:j].tobytes() for i, j in zip(begin, stop)],
                    "sizes": [measure[i:j].tobytes() for i, j in zip(begin, stop)],
                }
            )[_FOUND_NAMES]

    def given(bucket: int, rows: list) -> Iterator[pa.RecordBatch]:
        for frame in close(bucket, rows):
            yield pa.RecordBatch.from_pandas(frame, schema=_FOUND_ARROW, preserve_index=False)

    free_memory()
    bucket, rows = None, []
    for batch in batches:
        for number, *row in zip(*batch.columns):
            if rows and number.as_py() != bucket:
                yield from given(bucket, rows)
                rows = []
            bucket = number.as_py()
            rows.append([x.as_buffer() for x in row])
    if rows:
        yield from given(bucket, rows)


_FOUND_NAMES = [part.split()[0] for part in _FOUND.split(", ")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_FOUND_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in _FOUND.split(", "))])


def candidates(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """PAIR, SPENT and LIST rows of all documents; ``bounds`` are those of ``bucket_bounds``."""
    tasks = max(12, int(bounds[-1]))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    packed = rows.mapInArrow(_index(bounds), _PACKED)
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_lists, _FOUND)


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def bit_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the ids in the only column of ``ids``; its size is fixed, so it may be broadcast. ``passes`` reads it."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 15), pa.array(slot & 32767)], names=["part", "bit"])

    rows = ids.mapInArrow(places, "part long, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros((1 << (FILTER_BITS - 15), 4096), dtype=np.uint8)
    for r in rows:
        bits[r.part] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return bits


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = _slots(ids)
    return (bits[slot >> 15, (slot & 32767) >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents in ``wanted`` (doc_id); a bit filter of 2**FILTER_BITS bits keeps the others' texts
    from being cut and moved, and the few that pass it by chance meet no pair later."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        for batch in batches:
            chosen = batch.filter(pa.array(passes(shared.value, batch.column(0).to_numpy())))
            for first, end, data, offsets in byte_slices(chosen.column(1), SLICE):
                shingles, bounds = shingle_sets(data, offsets, WORDS)
                packed = [shingles[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([chosen.column(0).slice(first, end - first), pa.array(packed, pa.binary())], names=["doc_id", "shingles"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(gather, "doc_id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link, decided on the whole sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        for batch in batches:
            linked = []
            for one, two in zip(batch.column("x"), batch.column("y")):  # no copies of the sets
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                linked.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _opened(rows: pd.DataFrame, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members of LIST rows that pass ``bits``: their row, whether they are the first of it, document and size."""
    docs = [np.frombuffer(x, np.int64) for x in rows["members"]]
    sizes = [np.frombuffer(x, np.int64) for x in rows["sizes"]] if "sizes" in rows else docs
    doc, size = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (docs, sizes))
    row = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
    kept = passes(bits, doc)
    doc, size, row = doc[kept], size[kept], row[kept]
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    return row, first, doc, size


def _members(lists: DataFrame, keeps: np.ndarray) -> DataFrame:
    """(sig, leader, long, scheme, n, doc, size) of the list members that pass ``keeps``; the leader is the first of them in
    its row, ``long`` says that the list has more rows, ``n`` is its class of length."""
    shared = lists.sparkSession.sparkContext.broadcast(keeps)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            row, first, doc, size = _opened(rows, shared.value)
            leader = doc[first][np.cumsum(first) - 1] if len(doc) else doc
            long = rows["b"].to_numpy(dtype=bool)
            several = np.bincount(row, minlength=len(rows)) > 1 - long
            mine = several[row]
            row = row[mine]
            yield pd.DataFrame(
                {"sig": rows["a"].to_numpy()[row], "leader": leader[mine], "long": long[row], "scheme": rows["scheme"].to_numpy()[row],
                 "n": rows["n"].to_numpy()[row], "doc": doc[mine], "size": size[mine]}
            )

    columns = "sig long, leader long, long boolean, scheme int, n int, doc long, size long"
    return lists.select("a", "b", "scheme", "n", "members", "sizes").mapInPandas(members, columns)


def _kept_classes(spent: DataFrame) -> DataFrame:
    """(doc, scheme, keep) of sets whose hot segments cost more than they can spare: the hottest class of lists they keep.

    Whole classes are left out from the hottest down, as long as the spare units pay for them.
    """
    classes = spent.groupBy("a", "scheme", "n").agg(F.sum("b").alias("cost"), F.min("spare").alias("spare"))
    listed = classes.groupBy("a", "scheme").agg(
        F.sort_array(F.collect_list(F.struct("n", "cost")), asc=False).alias("classes"), F.min("spare").alias("spare"), F.sum("cost").alias("spent")
    )
    keep = (
        "aggregate(classes, named_struct('left', CAST(spare AS bigint), 'keep', -1), (s, x) -> CASE WHEN s.keep >= 0 THEN s"
        " WHEN x.cost <= s.left THEN named_struct('left', s.left - x.cost, 'keep', -1) ELSE named_struct('left', s.left, 'keep', x.n) END, s -> s.keep)"
    )
    return listed.where("spent > spare").select(F.col("a").alias("doc"), "scheme", F.expr(keep).alias("keep"))


#: Cells of a sketch. Two sets share at most the sum, over the cells, of the smaller of their two counts.
CELLS = 256


def sketches(sets: DataFrame) -> DataFrame:
    """(doc, sketch): how many shingles of a set fall into each cell, then 16 bits of each shingle; NULL if a cell has more than a
    byte holds. What two sets share is also at most the number of one's prints that the other has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one in batch.column(1):
                mixed = mix(np.frombuffer(one.as_buffer(), np.uint64))
                cells = np.bincount((mixed % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
                out.append(cells.astype(np.uint8).tobytes() + (mixed >> np.uint64(48)).astype("<u2").tobytes() if cells.max() < 256 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc", "sketch"])

    return sets.select("doc_id", "shingles").mapInArrow(count, "doc long, sketch binary")


class _Group:
    """The lists of one task's group: sketches of its documents, and the pairs found so far."""

    def __init__(self) -> None:
        self.docs: list[np.ndarray] = []
        self.cells: list[np.ndarray] = []
        self.prints: list[bytes] = []
        self.known: tuple[np.ndarray, ...] | None = None
        self.held: list[np.ndarray] = []
        self.rows = 0

    def learn(self, part: pd.DataFrame) -> None:
        cells = np.zeros((len(part), CELLS + 2), dtype=np.uint8)  # the last but one says that there is no sketch
        for k, x in enumerate(part["sketch"]):
            if x is None:
                cells[k, CELLS] = 1
            else:
                cells[k, :CELLS] = np.frombuffer(x, np.uint8, CELLS)
        self.docs.append(part["doc"].to_numpy())
        self.cells.append(cells)
        self.prints.extend(b"" if x is None else x[CELLS:] for x in part["sketch"])

    def add(self, doc: np.ndarray, size: np.ndarray, component: np.ndarray) -> Iterator[pd.DataFrame]:
        """Pairs of a list's members that are of different components and whose sizes allow a link."""
        order = np.argsort(size, kind="stable")
        doc, size, component = doc[order], size[order], component[order]
        reach = np.searchsorted(size, size * 4 // 3, "right")
        step = max(1, (1 << 19) // len(doc))
        for k in range(0, len(doc), step):
            end = int(reach[min(k + step, len(doc)) - 1])
            i, j = np.nonzero(component[k : k + step, None] != component[None, k:end])
            i, j = i + k, j + k
            fits = (j > i) & (j < reach[i])
            i, j = i[fits], j[fits]
            swap = doc[i] > doc[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            self.held.append(np.stack((doc[i], doc[j], size[i] + size[j]), axis=1))
            self.rows += len(i)
            if self.rows > PAIR_ROWS:
                yield from self.close()

    def close(self) -> Iterator[pd.DataFrame]:
        """Each pair once, but for those whose sketches rule a link out."""
        if not self.rows:
            return
        pairs = np.concatenate(self.held)
        self.held, self.rows = [], 0
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        fresh = np.ones(len(pairs), dtype=bool)
        fresh[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)
        pairs = pairs[fresh]
        if self.known is None:
            docs = np.concatenate([np.zeros(0, dtype=np.int64), *self.docs])
            order = np.argsort(docs)
            prints = np.frombuffer(b"".join(self.prints), "<u2")
            bounds = np.cumsum([0, *[len(x) // 2 for x in self.prints]])
            self.known = docs[order], order, np.concatenate([np.zeros((0, CELLS + 2), dtype=np.uint8), *self.cells]), prints, bounds
            self.docs, self.cells, self.prints = [], [], []
        docs, order, cells, prints, bounds = self.known
        x, y = (order[np.searchsorted(docs, pairs[:, c])] for c in (0, 1))
        open_ = np.zeros(len(pairs), dtype=bool)
        for k in range(0, len(pairs), 1 << 14):
            at = slice(k, k + (1 << 14))
            one, two = cells[x[at]], cells[y[at]]
            most = np.minimum(one[:, :CELLS], two[:, :CELLS]).sum(axis=1, dtype=np.int64)
            open_[at] = (7 * most >= 3 * pairs[at, 2]) | (one[:, CELLS] > 0) | (two[:, CELLS] > 0)
        pairs, x, y = pairs[open_], x[open_], y[open_]
        pairs = pairs[_may_link(prints, bounds, x, y, pairs[:, 2])]
        if len(pairs):
            yield pd.DataFrame(pairs[:, :2], columns=["a", "b"])


def _may_link(prints: np.ndarray, bounds: np.ndarray, x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether the sets ``x`` and ``y``, with ``total`` shingles in all, share enough prints; pairs with the same x are neighbours."""
    shared = np.zeros(len(x), dtype=np.int64)
    length = np.diff(bounds)
    has = np.zeros(1 << 16, dtype=bool)
    edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else []
    for begin, end in zip(edge[:-1], edge[1:]):
        mine = prints[bounds[x[begin]] : bounds[x[begin] + 1]]
        has[mine] = True
        for k in range(begin, end, 1024):
            at = y[k : min(k + 1024, end)]
            found = np.concatenate(([0], np.cumsum(has[prints[ranges(bounds[at], length[at])]])))
            shared[k : k + len(at)] = np.diff(found[np.concatenate(([0], np.cumsum(length[at])))])
        has[mine] = False
    return (7 * shared >= 3 * total) | (length[x] == 0) | (length[y] == 0)


def _made_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of groups of lists. A group's rows begin with the sketches of its documents, then come its lists by signature."""
    group, at, members, sig_at = None, None, [], None

    def listed() -> Iterator[pd.DataFrame]:
        if members:
            columns = [np.concatenate(x) for x in zip(*members)]
            members.clear()
            yield from group.add(*columns)

    for part in batches:
        first, task, sig, listing = (part[c].to_numpy() for c in ("first", "task", "sig", "listing"))
        fresh = np.ones(len(part), dtype=bool)
        for c in (first, task, sig, listing):
            fresh[1:] &= c[1:] == c[:-1]
        edge = np.flatnonzero(np.concatenate(([True], ~fresh[1:]))) if len(part) else []
        for begin, end in zip(edge, [*edge[1:], len(part)]):
            if (first[begin], task[begin]) != at:
                if group is not None:
                    yield from listed()
                    yield from group.close()
                group, at, sig_at = _Group(), (first[begin], task[begin]), None
            rows = part.iloc[begin:end]
            if not listing[begin]:
                group.learn(rows)
                continue
            if sig[begin] != sig_at:
                yield from listed()
                sig_at = sig[begin]
            members.append([rows[c].to_numpy() for c in ("doc", "size", "component")])
    if group is not None:
        yield from listed()
        yield from group.close()


def _across(member: DataFrame, sketch: DataFrame) -> DataFrame:
    """Different pairs (a, b) of ``member(sig, doc, size, component)`` that share a list and not the component, and that may link.

    Lists with the same smallest member share a task, as they are much alike; many such lists are dealt over several tasks.
    """
    mixed = member.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc").alias("first"), F.count("*").alias("n"))
    mixed = mixed.where("low <> high")
    led = mixed.groupBy("first").agg(F.ceil(F.sum("n") / PAIR_MEMBERS).alias("tasks"))
    placed = mixed.join(led.hint("rebalance"), "first").select("sig", "first", F.pmod(F.xxhash64("sig"), "tasks").alias("task"))
    rows = member.join(placed.hint("rebalance"), "sig").select("first", "task", F.lit(1).alias("listing"), "sig", "doc", "size", "component", F.lit(None).cast("binary").alias("sketch"))
    none = F.lit(0).cast("long")
    known = rows.select("first", "task", "doc").distinct().join(sketch.hint("rebalance"), "doc", "left").select(
        "first", "task", F.lit(0).alias("listing"), none.alias("sig"), "doc", none.alias("size"), none.alias("component"), "sketch"
    )
    order = ("first", "task", "listing", "sig")
    dealt = rows.union(known).repartition("first", "task").sortWithinPartitions(*order)
    return dealt.mapInPandas(_made_pairs, "a long, b long").distinct()


def _stars(lists: DataFrame, keeps: np.ndarray) -> DataFrame:
    """(a, b): each kept member with the leader of its list's row."""
    shared = lists.sparkSession.sparkContext.broadcast(keeps)

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            _, first, doc, _ = _opened(rows, shared.value)
            leader = doc[first][np.cumsum(first) - 1] if len(doc) else doc
            yield pd.DataFrame({"a": leader[~first], "b": doc[~first]}).drop_duplicates()

    return lists.select("members").mapInPandas(stars, "a long, b long").distinct()


def _enough(pairs: DataFrame, spent: DataFrame) -> DataFrame:
    """(a, b) of the pairs that share as many cheap signatures as two linked sets must.

    Of H + 1 + E segments at most H differ. What a set has not spent on empty and hot segments, without the D designated
    places, it must therefore share; sets that share just a passage share a few.
    """
    designated = F.get(F.array(*[F.lit(int(x)) for x in SCHEMES.designated]), F.col("scheme"))
    shared = pairs.groupBy("a", "b", "scheme").agg(F.sum("n").alias("n"), F.min("spare").alias("left_a"), F.min("other").alias("left_b"))
    paid = lambda end: spent.select(F.col("a").alias(end), "scheme", F.col("spent").alias(f"spent_{end}")).hint("rebalance")
    known = shared.join(paid("a"), ["a", "scheme"], "left").join(paid("b"), ["b", "scheme"], "left")
    least = F.greatest(*[F.col(f"left_{end}") - F.coalesce(f"spent_{end}", F.lit(0)) for end in ("a", "b")]) - designated + 1
    return known.where(F.col("n") >= least).select("a", "b").distinct()


def links(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Links (a, b) between different sets, as many as components need."""
    found = cut(candidates(docs, bounds), "jaccard-candidates", "zstd")
    lists, costs = found.where(F.col("kind") == LIST), found.where(F.col("kind") == SPENT)
    spent = cut(costs.groupBy("a", "scheme").agg(F.sum("b").alias("spent"), F.min("spare").alias("spare")), "jaccard-spent")
    keep = cut(_kept_classes(costs), "jaccard-classes")
    plain = _enough(found.where(F.col("kind") == PAIR), spent)
    overspent = bit_filter(keep.select("doc").distinct())
    stars = cut(_stars(lists, overspent), "jaccard-stars")
    first = cut(plain.union(stars).distinct(), "jaccard-pairs")
    sets = cut(sets_of(docs, first.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "jaccard-sets")
    linked = cut(verified(first, sets), "jaccard-links")
    discard(spent)
    part = cut(components(linked, "jaccard-first"), "jaccard-parts")
    # A list whose members all share its leader's component is done; the others, and those of several rows, compare their
    # members of different components.
    apart = (
        stars.join(part.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left")
        .join(part.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
        .where(F.coalesce("x", "a") != F.coalesce("y", "b"))
    )
    leaders = docs.sparkSession.sparkContext.broadcast(bit_filter(apart.select("a").distinct()))
    led = F.pandas_udf(lambda ids: pd.Series(passes(leaders.value, ids.to_numpy())), BooleanType())
    rows = _members(lists, overspent).where(F.col("long") | led("leader"))
    rows = rows.join(keep.hint("rebalance"), ["doc", "scheme"]).where("n <= keep")
    member = rows.join(part.hint("rebalance"), rows["doc"] == part["node"], "left").select("sig", "doc", "size", F.coalesce("component", "doc").alias("component"))
    member = cut(member, "jaccard-members")
    discard(found, keep, stars, part)
    second = cut(_across(member, sketches(sets)).join(first, ["a", "b"], "left_anti"), "jaccard-across")
    discard(member, first, sets)
    others = cut(sets_of(docs, second.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "jaccard-sets")
    every = cut(linked.union(verified(second, others)), "jaccard-all-links")
    discard(linked, second, others)
    return every


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows of ``docs`` (doc_id, text)."""
    with settings(docs.sparkSession, SMALL_BATCHES):
        rows = cut(document_sets(docs), "jaccard-documents")
        linked = links(docs, bucket_bounds(rows))
        part = components(linked, "jaccard-components")
    discard(linked)
    copies = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first"))
    named = copies.join(part.hint("rebalance"), copies["first"] == part["node"], "left").select("f1", "f2", "n", F.coalesce("component", "first").alias("component"))
    return rows.alias("r").join(named.hint("rebalance").alias("c"), ["f1", "f2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, of several such the first by its text's hash.

    Rows without doc_id come behind all others: each different text of theirs counts as a document.
    """
    nameless = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND((1 << 61) - 1)
    keyed = docs.select(whole_row(docs).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), nameless).alias("_key"), F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))
    parts = join_components(keyed.select(F.col("_key").alias("doc_id"), F.col("_text").alias("text")))
    firsts = parts.where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    # Rows that share a key are reduced to one before they are moved, so a third of all rows may be the same.
    single = keyed.groupBy("_key").agg(F.min_by("_row", "_hash").alias("_row"))
    return single.join(firsts.hint("rebalance"), "_key", "left_semi").select(*row_columns(docs, "_row"))
