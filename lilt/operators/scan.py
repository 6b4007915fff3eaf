"""Ordered scans that never put a whole recording into one task.

A plain ``Window.partitionBy(recording_id)`` sends every row of a recording to one task. One recording may hold a
large share of the table, so ordered work is done per *block* of consecutive rows instead:

* ``running``   cumulative values: block totals (partially aggregated before the shuffle) are scanned, and the carry
                is joined back to the rows of the block.
* ``adjacent``  lead/lag by one row: the edge rows of a block are carried like running values, over holes as well.
* ``attach``    lookup by a key that is hot on the row side: resolved once per (key, block), then joined to the rows.

Order columns may have holes; a block expression must be monotone in them. Keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16


def block_of(index: str, rows: int = BLOCK_ROWS) -> Column:
    return F.expr(f"`{index}` div {rows}")


@dataclass(frozen=True)
class Run:
    """One running value.

    ``op``: sum, max, min or last (latest non-NULL value in scan direction).
    ``inclusive``: whether the row itself counts. ``backward``: scan from the end.
    """

    op: str
    value: Column
    inclusive: bool = True
    backward: bool = False


def _fold(op: str, value: Column) -> Column:
    if op == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[op](value)


def _total(run: Run, value: Column, order: str) -> Column:
    if run.op != "last":
        return _fold(run.op, value)
    at = F.when(value.isNotNull(), F.col(order))
    return F.min_by(value, at) if run.backward else F.max_by(value, at)


def _merge(run: Run, local: Column, carried: Column) -> Column:
    if run.op == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if run.op == "last":
        return F.coalesce(local, carried)
    return F.greatest(local, carried) if run.op == "max" else F.least(local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    runs: Mapping[str, Run],
    blocks: Sequence[Column] | None = None,
    tag: str = "_blk",
    keep: str | None = None,
) -> DataFrame:
    """Add one column per entry of ``runs``.

    ``blocks`` lists block numbers from fine to coarse, each monotone in ``order``; the coarser ones serve to scan
    the block totals when a key has very many blocks. The default is a single level of ``BLOCK_ROWS`` rows. ``keep`` names
    a column for the block number, by which (and the keys) the result is partitioned.
    """
    keys = list(keys)
    blocks = list(blocks) if blocks else [block_of(order)]
    values = {f"_v_{n}": r.value for n, r in runs.items()}
    levels = [f"{tag}{i}" for i in range(len(blocks))]
    rows = df.withColumns(dict(zip(levels, blocks, strict=True)) | values)

    totals = rows.groupBy(*keys, *levels).agg(
        *[_total(r, F.col(f"_v_{n}"), order).alias(f"_t_{n}") for n, r in runs.items()]
    )
    carry = _carry(totals, keys, levels, runs)
    out = rows.join(carry, [*keys, levels[0]])

    ahead = Window.partitionBy(*keys, levels[0]).orderBy(order)
    back = Window.partitionBy(*keys, levels[0]).orderBy(F.desc(order))
    columns = {}
    for name, run in runs.items():
        frame = (back if run.backward else ahead).rowsBetween(
            Window.unboundedPreceding, 0 if run.inclusive else -1
        )
        columns[name] = _merge(run, _fold(run.op, F.col(f"_v_{name}")).over(frame), F.col(f"_c_{name}"))
    drop = [*levels[bool(keep) :], *values, *[f"_c_{n}" for n in runs]]
    done = out.withColumns(columns).drop(*drop)
    return done.withColumnRenamed(levels[0], keep) if keep else done


def _carry(totals: DataFrame, keys: list[str], levels: list[str], runs: Mapping[str, Run]) -> DataFrame:
    """Value carried into each block from the blocks before it (after it, for backward runs)."""
    fine = levels[0]
    if len(levels) > 1:
        inner = {
            f"c_{n}": Run(r.op, F.col(f"_t_{n}"), inclusive=False, backward=r.backward) for n, r in runs.items()
        }
        scanned = running(totals, keys, fine, inner, blocks=[F.col(c) for c in levels[1:]], tag=f"{fine}_")
        return scanned.select(*keys, fine, *[F.col(f"c_{n}").alias(f"_c_{n}") for n in runs])
    ahead = Window.partitionBy(*keys).orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.desc(fine)).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys,
        fine,
        *[
            _fold(r.op, F.col(f"_t_{n}")).over(back if r.backward else ahead).alias(f"_c_{n}")
            for n, r in runs.items()
        ],
    )


def adjacent(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    lead: Mapping[str, Column] | None = None,
    lag: Mapping[str, Column] | None = None,
    rows: int = BLOCK_ROWS,
    keep: str | None = None,
) -> DataFrame:
    """Add values of the next (``lead``) and previous (``lag``) row of the same key, however far away it is.

    ``keep`` names a column for the block number. The result is partitioned by the keys and that column, so a
    following ``running`` over ``blocks=[col(keep)]`` needs no further shuffle of the rows.
    """
    held = lambda columns: F.struct(*[c.alias(n) for n, c in columns.items()])
    runs = {}
    if lead:
        runs["_ahead"] = Run("last", held(lead), inclusive=False, backward=True)
    if lag:
        runs["_behind"] = Run("last", held(lag), inclusive=False)
    placed = running(df, keys, order, runs, [block_of(order, rows)], keep=keep)
    out = {n: F.col("_ahead")[n] for n in (lead or {})} | {n: F.col("_behind")[n] for n in (lag or {})}
    return placed.withColumns(out).drop(*runs)


def text_pieces(rows: DataFrame, keys: Sequence[str], order: str, blocks: Sequence[Column] | None = None) -> DataFrame:
    """``rows`` with ``text`` as pieces of one text per key, joined by one blank: adds ``offset`` and ``total_chars``."""
    keys = list(keys)
    sized = rows.withColumn("_n", F.char_length("text").cast("bigint") + 1)
    return totalled(sized, keys, order, "_n", "offset", "total_chars", blocks).withColumn("total_chars", F.col("total_chars") - 1).drop("_n")


def totalled(
    rows: DataFrame, keys: Sequence[str], order: str, size: str, offset: str, total: str, blocks: Sequence[Column] | None = None
) -> DataFrame:
    """Adds the sum of ``size`` before a row and over all rows of its key. Both come from the scan's carries: what is before a
    row and what is from it on make up the whole, so no row is moved by its key alone."""
    value = F.col(size)
    runs = {offset: Run("sum", value, inclusive=False), "_rest": Run("sum", value, backward=True)}
    return running(rows, keys, order, runs, blocks).withColumn(total, F.col(offset) + F.col("_rest")).drop("_rest")


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "left",
) -> DataFrame:
    """Join ``lookup`` (at most one row per ``keys``) to ``rows`` whose keys may be hot.

    ``spread`` is a block number of the row. The distinct (keys, block) pairs are resolved first, so neither join
    meets more than one block of rows per key.
    """
    keys = list(keys)
    placed = rows.withColumn("_spread", spread)
    resolved = placed.select(*keys, "_spread").distinct().join(lookup, keys, how)
    return placed.join(resolved, [*keys, "_spread"], how).drop("_spread")
