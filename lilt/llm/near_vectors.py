"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1 and hashed in several tables; a table's key is ``m`` values floor((a.v + b) / w) with normal
a. A query visits, besides its own bucket, those buckets whose keys differ by one step in some coordinates, in the order
of estimated success: the squared distances to the crossed bucket borders, by the order of their expected values, so one list
of perturbation sets serves all queries. Candidates of all tables are merged and ranked by their exact cosine.

The key length starts from the table's size (0.64 bits a doubling) and the probes from the key length (7 x 1.5^m a table). Both are
then set by measurement: the true neighbours of at most ``SAMPLE`` queries are found by brute force over all rows, and the place of
each in its query's probes tells the recall of any number of probes. Probes are added until ``TARGET`` of the sample's
neighbours are found; where ``MORE_PROBES`` times the first number isn't enough, keys get shorter, down to one bucket that holds all
rows. ``recall`` measures the result against brute force.

Index rows are range-partitioned by bucket and packed into blocks of equal size, so a bucket that holds a third of all
rows spreads over many blocks. A block of queries sends each index block only its probes that fall into it. No candidate is capped.

Edges: vectors that are NULL, zero or hold NULL or non-finite components take no part, neither do rows without id; of a repeated
id the smallest vector stays; shorter vectors count as filled with zeros; ties go to smaller ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lilt.llm import vectors as vec
from lilt.llm.common import mix, ranges
from lilt.session import cut

TABLES = 8
#: Bucket width in standard deviations of a projection.
WIDTH = 2.0
#: Queries whose true neighbours are found, and the share of these that probes must reach: 0.9 and a margin for the sample.
SAMPLE = 256
TARGET = 0.93
MORE_PROBES = 4


def key_length(n: int) -> int:
    return max(4, round(0.64 * math.log2(max(2, n))))


def probe_count(m: int) -> int:
    return round(7 * 1.5**m)


def perturbations(m: int, count: int) -> np.ndarray:
    """The first ``count`` sets of ranks (1 to 2m, by distance to the border) in order of expected cost; the empty set is first.

    Ranks j and 2m + 1 - j are the two borders of one coordinate, so no set holds both."""
    if not m:  # no coordinate, one bucket
        return np.zeros((1, 0), dtype=np.uint64)
    half = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost = [0.0, *half, *[1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]]
    out = [()]
    heap: list[tuple[float, tuple[int, ...]]] = [(cost[1], (1,))]
    while heap and len(out) < count:
        total, ranks = heapq.heappop(heap)
        if all(2 * m + 1 - j not in ranks for j in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    sets = np.zeros((len(out), 2 * m), dtype=np.uint64)
    for k, ranks in enumerate(out):
        sets[k, [j - 1 for j in ranks]] = 1
    return sets


class Hashes:
    """Projections of all tables, drawn from a seed."""

    def __init__(self, dim: int, m: int, tables: int, seed: int):
        draw = np.random.default_rng(seed)
        self.m, self.tables = m, tables
        self.width = WIDTH / math.sqrt(dim)
        self.a = draw.standard_normal((tables, dim, m)) / math.sqrt(dim)
        self.b = draw.random((tables, m)) * self.width
        self.spread = mix(np.arange(1, tables * m + 1, dtype=np.uint64)).reshape(tables, m) | np.uint64(1)
        self.mark = mix(np.arange(1001, 1001 + tables, dtype=np.uint64))

    def keys(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket numbers before the last mixing, place inside the cells) of unit vectors."""
        place = (x @ self.a[table] + self.b[table]) / self.width
        cell = np.floor(place)
        return self.mark[table] + (cell.astype(np.int64).view(np.uint64) * self.spread[table]).sum(axis=1, dtype=np.uint64), place - cell

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys).view(np.int64)

    def probes(self, x: np.ndarray, table: int, sets: np.ndarray) -> np.ndarray:
        """Buckets of each vector in visiting order: (vectors, sets)."""
        keys, inside = self.keys(x, table)
        gaps = np.concatenate((inside, 1 - inside), axis=1)
        order = np.argsort(gaps, axis=1, kind="stable")
        step = np.concatenate((np.zeros_like(self.spread[table]) - self.spread[table], self.spread[table]))[order]
        return self.bucket(keys[:, None] + (step @ sets.T))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest part so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _search(dim: int, k: int, tables: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, dtype=np.int64)
        found = (none, none, np.zeros(0))
        for part in batches:
            for row in part.itertuples(index=False):
                q_ids, q = vec.unpack(row.q_ids, row.q_vectors, dim, "float64")
                ids, v = vec.unpack(row.ids, row.vectors, dim, "float64")
                buckets = np.frombuffer(row.buckets, dtype=np.int64)
                probe, who = np.frombuffer(row.probe, dtype=np.int64), np.frombuffer(row.who, dtype=np.int32)
                low, high = np.searchsorted(buckets, probe, "left"), np.searchsorted(buckets, probe, "right")
                hit = np.zeros((len(q), len(v)), dtype=bool)
                hit[np.repeat(who, high - low), ranges(low, high - low)] = True
                hit &= q_ids[:, None] != ids[None, :]
                score = _unit(q) @ _unit(v).T
                shown = np.where(hit, score, -np.inf)
                most = k * tables  # a vector is in the block once for each table at most
                if len(v) > most:
                    hit &= shown >= np.partition(shown, len(v) - most, axis=1)[:, len(v) - most][:, None] - 1e-9
                i, j = np.nonzero(hit)
                # The same expression for every pair, whatever block it is in, so that equal vectors tie.
                exact = np.einsum("ij,ij->i", _unit(q)[i], _unit(v)[j]) if len(i) else np.zeros(0)
                found = vec.best(np.concatenate((found[0], q_ids[i])), np.concatenate((found[1], ids[j])), np.concatenate((found[2], exact)), k)
        yield pd.DataFrame({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    return search


def _sampled(found: DataFrame, is_query: Column, dim: int, k: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, neighbours): unit vectors of the true k nearest of at most ``sample`` queries, by hash of their ids, pair by pair."""
    asked = found.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(asked):
        return np.zeros((0, dim)), np.zeros((0, dim))
    q_ids, q = asked["vec_id"].to_numpy(dtype=np.int64), _unit(vec.matrix(asked["v"].tolist(), dim))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, dtype=np.int64)
        best = (none, none, np.zeros(0))
        for part in vec.chunks(batches, 4096):
            ids = part["vec_id"].to_numpy(dtype=np.int64)
            score = np.where(q_ids[:, None] == ids[None, :], -np.inf, q @ _unit(vec.matrix(part["v"].tolist(), dim)).T)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            i, j = np.repeat(np.arange(len(q_ids)), top.shape[1]), top.ravel()
            real = np.isfinite(score[i, j])
            i, j = i[real], j[real]
            best = vec.best(np.concatenate((best[0], q_ids[i])), np.concatenate((best[1], ids[j])), np.concatenate((best[2], score[i, j])), k)
        yield pd.DataFrame({"query_id": best[0], "vec_id": best[1], "score": best[2]})

    true = vec.ranked(found.mapInPandas(scan, "query_id long, vec_id long, score double"), k)
    pairs = true.join(found, "vec_id").select("query_id", "v").toPandas()
    if not len(pairs):
        return np.zeros((0, dim)), np.zeros((0, dim))
    at = {x: n for n, x in enumerate(q_ids.tolist())}
    return q[[at[x] for x in pairs["query_id"]]], _unit(vec.matrix(pairs["v"].tolist(), dim))


def places(hashes: Hashes, sets: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Per pair, the smallest place over all tables of the bucket of v among the probes of q; len(sets) if it isn't among them."""
    out = np.full(len(q), len(sets), dtype=np.int64)
    for table in range(hashes.tables):
        bucket = hashes.bucket(hashes.keys(v, table)[0])
        for a in range(0, len(q), 128):
            hit = hashes.probes(q[a : a + 128], table, sets) == bucket[a : a + 128, None]
            out[a : a + 128] = np.minimum(out[a : a + 128], np.where(hit.any(axis=1), hit.argmax(axis=1), len(sets)))
    return out


def tuned(dim: int, n: int, tables: int, seed: int, q: np.ndarray, v: np.ndarray, target: float = TARGET) -> tuple[Hashes, np.ndarray]:
    """Projections and perturbation sets that find ``target`` of the pairs (q, v)."""
    for m in range(key_length(n), -1, -1):
        hashes, first = Hashes(dim, m, tables, seed), probe_count(m)
        sets = perturbations(m, MORE_PROBES * first)
        place = np.sort(places(hashes, sets, q, v))
        need = int(place[math.ceil(target * len(place)) - 1]) + 1 if len(place) else 1
        if need <= len(sets):
            return hashes, sets[: max(first, need)]
    raise AssertionError("one bucket holds all rows")


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, seed: int = 11, block_rows: int = 4096, query_rows: int = 512
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (on vec_id) the k nearest found among all other rows."""
    usable = vec.usable(rows, lambda x: x).where(F.exists("v", lambda x: x != 0))
    found = cut(usable, "near-vectors")
    dim, n = max(1, vec.dimension(found)), found.count()
    hashes, sets = tuned(dim, n, tables, seed, *_sampled(found, is_query, dim, k, SAMPLE))
    n_blocks = max(1, -(-n * tables // block_rows))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = _unit(vec.matrix(part["v"].tolist(), dim))
            for table in range(tables):
                yield pd.DataFrame({"bucket": hashes.bucket(hashes.keys(x, table)[0]), "vec_id": part["vec_id"], "v": part["v"]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for seq, part in enumerate(vec.chunks(batches, block_rows)):
            yield pd.DataFrame(
                {
                    "block": [(int(part["part"].iloc[0]) << 24) + seq],
                    "low": [int(part["bucket"].iloc[0])],
                    "high": [int(part["bucket"].iloc[-1])],
                    "buckets": [part["bucket"].to_numpy(dtype=np.int64).tobytes()],
                    "ids": [part["vec_id"].to_numpy(dtype=np.int64).tobytes()],
                    "vectors": [vec.matrix(part["v"].tolist(), dim).tobytes()],
                }
            )

    index = (
        found.mapInPandas(hashed, "bucket long, vec_id long, v array<double>")
        .repartitionByRange(n_blocks, "bucket", "vec_id")
        .sortWithinPartitions("bucket", "vec_id")
        .withColumn("part", F.spark_partition_id())
        .mapInPandas(packed, "block long, low long, high long, buckets binary, ids binary, vectors binary")
    )
    blocks = cut(index, "near-index")
    # Two numbers per index block, about (rows x tables / block_rows) of them.
    spans = blocks.select("block", "low", "high").orderBy("block").toPandas()
    names, lows, highs = (spans[c].to_numpy(dtype=np.int64) for c in ("block", "low", "high"))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in vec.chunks(batches, query_rows):
            ids, raw = part["vec_id"].to_numpy(dtype=np.int64), vec.matrix(part["v"].tolist(), dim)
            x = _unit(raw)
            probe = np.concatenate([hashes.probes(x, table, sets) for table in range(tables)], axis=1)
            who = np.repeat(np.arange(len(ids), dtype=np.int32), probe.shape[1])
            order = np.argsort(probe.ravel(), kind="stable")
            probe, who = probe.ravel()[order], who[order]
            for name, low, high in zip(names, lows, highs):
                a, z = np.searchsorted(probe, low, "left"), np.searchsorted(probe, high, "right")
                if a < z:
                    mine, local = np.unique(who[a:z], return_inverse=True)
                    yield pd.DataFrame(
                        {
                            "block": [int(name)], "q_ids": [ids[mine].tobytes()], "q_vectors": [raw[mine].tobytes()],
                            "probe": [probe[a:z].tobytes()], "who": [local.astype(np.int32).tobytes()],
                        }
                    )

    asked = found.where(is_query).mapInPandas(routed, "block long, q_ids binary, q_vectors binary, probe binary, who binary")
    searched = asked.join(blocks, "block").mapInPandas(_search(dim, k, tables), "query_id long, vec_id long, score double")
    return vec.ranked(searched, k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true (query_id, vec_id) rows that were found."""
    hit = true.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, true.count())
