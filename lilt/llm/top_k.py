"""Exact top-k inner products over norm-sorted blocks with rotated partial sums.

Vectors are whole numbers. The second-moment matrix of all vectors is summed in Spark; its eigenvectors (the right
singular vectors of the table) rotate queries and candidates, so that the first few coordinates carry most of an inner
product. Candidates are range-partitioned by descending length and packed into blocks. A task takes one block of queries
and one stripe of candidate blocks, longest first. It skips all further blocks once the product of lengths can't
reach any query's k-th best score, and inside a block it computes exact products only where the partial sum over the leading
coordinates plus the product of the residual lengths (Cauchy-Schwarz) reaches that score. Scores are exact; rounding of the
bounds is covered by a margin.

The stated queries meet all rows block by block, and a task gives at most k rows per query.

Edges: vectors that are NULL or hold NULL or non-finite components take no part, neither do rows without id; of a repeated id
the smallest vector stays; shorter vectors count as filled with zeros; ties go to smaller ids; without candidates or
queries the result is empty; sums beyond 64 bits end at the limits of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lilt.llm import vectors as vec
from lilt.session import cut

HEAD = 16
#: Blocks are at most this many; with more rows they grow.
MOST_BLOCKS = 65_536


def second_moments(rows: DataFrame, dim: int) -> np.ndarray:
    """Sum of v v' over all rows; dim x dim numbers reach the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for part in batches:
            x = vec.matrix(part["v"].tolist(), dim)
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total)})

    parts = rows.select("v").mapInPandas(sums, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((dim, dim))
    out[cells["i"], cells["j"]] = cells["x"]
    return out


def exact_products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer products of all pairs of rows: in doubles where these are exact, else in whole numbers."""
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if reach < 2.0**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    if reach < 2.0**62:
        return queries @ candidates.T
    wide = queries.astype(object) @ candidates.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def _search(dim: int, k: int, turn: np.ndarray, head: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, {}

        def begin(row) -> dict:
            ids, q = vec.unpack(row.q_ids, row.q_vectors, dim, "int64")
            rotated = q @ turn
            none = np.zeros(0, dtype=np.int64)
            return {
                "ids": ids, "q": q, "head": rotated[:, :head], "rest": np.linalg.norm(rotated[:, head:], axis=1),
                "length": np.linalg.norm(q.astype(np.float64), axis=1), "least": np.full(len(ids), -np.inf), "found": (none, none, none), "done": False,
            }

        def visit(state: dict, row) -> None:
            ids, v = vec.unpack(row.ids, row.vectors, dim, "int64")
            length = np.linalg.norm(v.astype(np.float64), axis=1)
            margin = 1e-7 * state["length"] * length.max() + 1e-6
            if (state["length"] * length.max() + margin < state["least"]).all():
                state["done"] = True  # all further blocks hold shorter vectors
                return
            rotated = v @ turn
            bound = state["head"] @ rotated[:, :head].T + np.outer(state["rest"], np.linalg.norm(rotated[:, head:], axis=1))
            open_pairs = bound + margin[:, None] >= state["least"][:, None]
            rows = np.flatnonzero(open_pairs.any(axis=1))
            columns = np.flatnonzero(open_pairs.any(axis=0))
            if not len(rows):
                return
            score = exact_products(state["q"][rows], v[columns])
            open_pairs = open_pairs[np.ix_(rows, columns)] & (state["ids"][rows][:, None] != ids[columns][None, :])
            # No pair below the k-th best of this block can be among the k best.
            shown = np.where(open_pairs, score.astype(np.float64), -np.inf)
            if shown.shape[1] > k:
                open_pairs &= shown >= np.partition(shown, shown.shape[1] - k, axis=1)[:, shown.shape[1] - k][:, None]
            i, j = np.nonzero(open_pairs)
            old = state["found"]
            query, near, value = vec.best(
                np.concatenate((old[0], rows[i])), np.concatenate((old[1], ids[columns[j]])), np.concatenate((old[2], score[i, j])), k
            )
            state["found"] = (query, near, value)
            full = np.bincount(query, minlength=len(state["ids"])) >= k
            last = np.searchsorted(query, np.arange(len(full)), "right") - 1
            state["least"] = np.where(full, value[last].astype(np.float64) if len(value) else 0.0, -np.inf)

        def close(state: dict) -> pd.DataFrame:
            query, near, value = state["found"]
            return pd.DataFrame({"query_id": state["ids"][query], "vec_id": near, "score": value})

        for part in batches:
            for row in part.itertuples(index=False):
                if at != (row.q_block, row.stripe):
                    if state:
                        yield close(state)
                    at, state = (row.q_block, row.stripe), begin(row)
                if not state["done"]:
                    visit(state, row)
        if state:
            yield close(state)

    return search


def top_k(rows: DataFrame, is_query: Column, value, k: int = 5, block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (on vec_id) its k highest products with all other rows."""
    found = cut(vec.usable(rows, value), "topk-vectors")
    dim = vec.dimension(found)
    n = found.count()
    if not n or not dim:
        dim = max(dim, 1)
    _, turn = np.linalg.eigh(second_moments(found, dim))
    turn = np.ascontiguousarray(turn[:, ::-1])
    block_rows = max(block_rows, -(-n // MOST_BLOCKS))
    n_blocks = max(1, -(-n // block_rows))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    by_length = found.withColumn("length", length).repartitionByRange(n_blocks, F.col("length").desc(), "vec_id").sortWithinPartitions(F.col("length").desc(), "vec_id")
    blocks = cut(vec.packed(by_length, dim, block_rows, "int64"), "topk-blocks")
    queries = cut(vec.packed(found.where(is_query), dim, query_rows, "int64"), "topk-queries")
    stripes = max(-(-n_blocks // 16), min(n_blocks, 8))
    pairs = (
        queries.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
        .withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
        .join(blocks.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int")), "stripe")
    )
    searched = (
        pairs.repartition("q_block", "stripe")
        .sortWithinPartitions("q_block", "stripe", "block")
        .mapInPandas(_search(dim, k, turn, min(HEAD, dim)), "query_id long, vec_id long, score long")
    )
    return vec.ranked(searched, k)
