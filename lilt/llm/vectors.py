"""Vectors as blocks: rows packed into one binary row each, so that tasks work on matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, value: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of rows with an id whose vector is neither NULL nor holds NULL or non-finite components.

    ``value`` maps each component, taken as double. If an id repeats, its smallest vector stays.
    """
    good = F.col(vector).isNotNull() & F.col(key).isNotNull()
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    typed = rows.where(good).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    return typed.where(sound).groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", F.transform("x", value).alias("v"))


def dimension(rows: DataFrame) -> int:
    """Largest length of a vector; shorter ones count as filled with zeros."""
    return int(rows.agg(F.max(F.size("v"))).first()[0] or 0)


def matrix(vectors, dim: int, dtype=np.float64) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype=dtype)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows of a partition in order, ``size`` at a time."""
    held, n = [], 0
    for rows in batches:
        while len(rows):
            take = rows.iloc[: size - n]
            held.append(take)
            n += len(take)
            rows = rows.iloc[len(take) :]
            if n == size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def packed(rows: DataFrame, dim: int, block_rows: int, dtype: str) -> DataFrame:
    """(block, n, ids, vectors) in the order of the partitions: block numbers ascend with the partition and inside it."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for seq, part in enumerate(chunks(batches, block_rows)):
            yield pd.DataFrame(
                {
                    "block": [(int(part["part"].iloc[0]) << 24) + seq],
                    "n": [len(part)],
                    "ids": [part["vec_id"].to_numpy(dtype=np.int64).tobytes()],
                    "vectors": [matrix(part["v"].tolist(), dim, np.dtype(dtype)).tobytes()],
                }
            )

    numbered = rows.select("vec_id", "v", F.spark_partition_id().alias("part"))
    return numbered.mapInPandas(pack, "block long, n long, ids binary, vectors binary")


def unpack(ids: bytes, vectors: bytes, dim: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(vectors, dtype=np.dtype(dtype)).reshape(-1, dim)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest different (query, id) rows of each query, ties to smaller ids."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    fresh = np.ones(len(query), dtype=bool)
    fresh[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    query, ids, scores = query[fresh], ids[fresh], scores[fresh]
    begin = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - begin < k
    return query[keep], ids[keep], scores[keep]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest of each query over all tasks."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
