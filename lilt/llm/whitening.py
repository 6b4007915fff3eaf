"""Whitening of vectors by the leading eigenvectors of their covariance, found by FEAST contour integration.

Spark reads the table three times and moves only dim x dim sums: the first time count and exact whole-number sums per
dimension, then the covariance of the rows centred on their exact mean, at last the covariance of the whitened rows, which says
how far it is from the identity. The eigenproblem is that of one dim x dim matrix on the driver:

* The spectrum is cut into intervals of a few eigenvalues. How many eigenvalues lie above a border is the inertia of the
  shifted matrix (Sylvester), read from the signs of the pivot blocks of a symmetric indefinite factorisation.
* For each interval a random subspace is filtered: the resolvent's contour integral around the interval, by Gauss-Legendre
  quadrature on a half circle, with one complex shifted solve per node. Rayleigh-Ritz on the filtered subspace gives
  eigenpairs; both steps repeat until the residuals are at the level of rounding.
* An interval is done when it holds as many eigenpairs as the inertia counts say; otherwise the subspace grows. A border that
  meets an eigenvalue is moved into the widest gap near it, and equal eigenvalues stay in one interval.

Edges: vectors that are NULL or hold NULL or non-finite components take no part; repeated rows, repeated and NULL ids count
each as a row; shorter vectors count as filled with zeros; whole numbers beyond 2**52 end there; deviations beyond a long are
NULL; components whose variance is zero (below 1e-12 of the trace) can't be whitened and have no rows, so a single row or equal
rows give an empty result, as an empty table does; among equal eigenvalues any orthogonal basis of their space may come; each
component's sign is fixed by its largest entry; further columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2**52
#: Quadrature nodes on the half circle, eigenvalues of an interval, rows of a matrix in a task.
NODES = 8
IN_INTERVAL = 12
BATCH_ROWS = 4096
_TINY = 1e-12


# --- the eigenproblem of one symmetric matrix ---------------------------------------------------------------------------


def positive_count(a: np.ndarray) -> tuple[int, float]:
    """(eigenvalues above zero, smallest pivot) by a symmetric factorisation with 1 x 1 and 2 x 2 pivot blocks."""
    a = np.array(a, dtype=np.float64)
    n, count, least, k = len(a), 0, np.inf, 0
    edge = (1 + 17**0.5) / 8
    while k < n:
        rest = a[k:, k:]
        diagonal = np.abs(np.diag(rest))
        off = np.abs(np.tril(rest, -1))
        p = int(diagonal.argmax())
        high = off.max(initial=0.0)
        if diagonal[p] >= edge * high or n - k == 1:
            if p:
                rest[[0, p]] = rest[[p, 0]]
                rest[:, [0, p]] = rest[:, [p, 0]]
            pivot = rest[0, 0]
            least = min(least, abs(pivot))
            count += pivot > 0
            if pivot and n - k > 1:
                rest[1:, 1:] -= np.outer(rest[1:, 0], rest[0, 1:]) / pivot
            k += 1
            continue
        i, j = np.unravel_index(off.argmax(), off.shape)
        for at, to in ((j, 0), (i, 1)):
            rest[[at, to]] = rest[[to, at]]
            rest[:, [at, to]] = rest[:, [to, at]]
        block = rest[:2, :2]
        values = np.linalg.eigvalsh(block)
        least = min(least, np.abs(values).min())
        count += int((values > 0).sum())
        if n - k > 2:
            rest[2:, 2:] -= rest[2:, :2] @ np.linalg.solve(block, rest[:2, 2:])
        k += 2
    return count, float(least)


def count_above(v: np.ndarray, border: float) -> int:
    return positive_count(v - border * np.eye(len(v)))[0]


def borders(v: np.ndarray, wanted: int, most: int = IN_INTERVAL) -> list[tuple[float, int]]:
    """Descending (border, eigenvalues above it) from above the spectrum down to one with at least ``wanted`` above.

    Each step takes in at most ``most`` more, but for equal ones, and lies in the widest gap found near its place.
    """
    scale = float(np.abs(v).sum(axis=1).max())
    bottom = -1e-6 * scale
    out = [(scale * (1 + 1e-6), 0)]
    while out[-1][1] < wanted:
        high, have = out[-1]
        goal = min(wanted, have + most)
        low, top = bottom, high  # at least ``goal`` above low, fewer above top
        while top - low > 4e-15 * scale:
            mid = (low + top) / 2
            if count_above(v, mid) >= goal:
                low = mid
            else:
                top = mid
            if top <= low:
                break
        # ``low`` touches the goal-th eigenvalue from below; go down as far as no further one is met.
        count = count_above(v, low)
        step, border = 1e-14 * scale, low
        while border - step > bottom and count_above(v, border - step) == count:
            border -= step
            step *= 2
        out.append(((low + border) / 2 if border < low else low, count))
    return out


def _filtered(v: np.ndarray, q: np.ndarray, low: float, high: float, nodes: int) -> np.ndarray:
    """The projection of q onto the eigenvectors of [low, high]: quadrature of shifted solves over a half circle."""
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(nodes)
    out = np.zeros_like(q)
    for place, weight in zip(x, w):
        turn = np.exp(1j * np.pi * (1 - place) / 2)
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, q.astype(complex))
        out += weight / 2 * radius * (turn * solved).real
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, nodes: int = NODES, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of v between low and high (ascending); ``count`` comes from the inertia of both borders."""
    n, scale = len(v), max(float(np.abs(v).max()), 1e-300)
    size = min(n, count + max(4, count // 2))
    draw = np.random.default_rng(11)
    while True:
        q = draw.standard_normal((n, size))
        worst, stalled = np.inf, 0
        for _ in range(rounds):
            left, strength, _ = np.linalg.svd(_filtered(v, q, low, high, nodes), full_matrices=False)
            basis = left[:, strength > 1e-13 * strength[0]]
            values, turn = np.linalg.eigh(basis.T @ v @ basis)
            q = basis @ turn
            inside = (values > low) & (values < high)
            gap = np.linalg.norm(v @ q[:, inside] - q[:, inside] * values[inside], axis=0).max(initial=0.0) / scale
            if inside.sum() == count:
                stalled = stalled + 1 if gap > worst / 2 else 0
                worst = min(worst, gap)
                if gap < 1e-15 * n or (stalled > 1 and gap < 1e-12 * n):
                    return values[inside], q[:, inside]
            missing = size - q.shape[1]
            if missing:  # directions without strength are drawn anew
                q = np.column_stack((q, draw.standard_normal((n, missing))))
        if size == n:
            raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues found between {low} and {high}")
        size = min(n, 2 * size)


def leading_pairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    wanted = min(wanted, len(v))
    cuts = borders(v, wanted)
    values, vectors = [], []
    for (high, above), (low, below) in zip(cuts, cuts[1:]):
        e, x = feast(v, low, high, below - above)
        values.append(e[::-1])
        vectors.append(x[:, ::-1])
    e, x = np.concatenate(values), np.column_stack(vectors)
    # Neighbouring intervals agree to rounding only; one more step makes all columns orthogonal together.
    x, _ = np.linalg.qr(x)
    inner, turn = np.linalg.eigh(x.T @ v @ x)
    order = np.argsort(-inner, kind="stable")[:wanted]
    x, e = (x @ turn)[:, order], inner[order]
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(wanted)])
    return e, x * np.where(signs == 0, 1, signs)


# --- the table ----------------------------------------------------------------------------------------------------------


def whole_numbers(vectors: pd.Series, dim: int, factor: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their whole numbers): floor(factor * component) + shift."""
    column = pa.Array.from_pandas(vectors, type=pa.list_(pa.float64()))
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    present = np.array([x is not None for x in vectors], dtype=bool)
    sizes = np.where(present, sizes, 0)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL becomes NaN
    row = np.repeat(np.arange(len(vectors)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    present[row[~np.isfinite(values)]] = False
    dense = np.zeros((len(vectors), dim))
    inside = np.isfinite(values)
    dense[row[inside], place[inside]] = values[inside]
    good = np.flatnonzero(present)
    return good, np.clip(np.floor(dense[good] * factor), -LIMIT, LIMIT).astype(np.int64) + shift


@dataclass
class Whitening:
    """What makes vectors white: dimension, count, exact sums, eigenvalues and vectors, trace, and the distance from the identity."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    factor: float
    shift: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: in 64 bits where they suffice."""
        reach = 2 * (self.n + 1) * (int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) // max(self.n, 1) + 1)
        if reach < 2**62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _matrices(batches: Iterator[pd.DataFrame], dim: int, factor: float, shift: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for part in batches:
        for k in range(0, len(part), BATCH_ROWS):
            rows = part.iloc[k : k + BATCH_ROWS]
            good, x = whole_numbers(rows["v"], dim, factor, shift)
            yield rows.iloc[good], x


def _moments(rows: DataFrame, dim: int, width: int, value: Callable[[np.ndarray], np.ndarray], factor: float, shift: int) -> np.ndarray:
    """Sum of y y' over all rows, y = value(x) with a one in front: counts, sums and products in one matrix.

    A task gives one matrix; they are added cell by cell in Spark, so (width + 1)**2 numbers reach the driver.
    """
    size = width + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for _, x in _matrices(batches, dim, factor, shift):
            y = np.column_stack((np.ones(len(x)), value(x)))
            total += y.T @ y
        yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

    parts = rows.select("v").mapInPandas(sums, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((size, size))
    out[cells["i"], cells["j"]] = cells["x"]
    return out


def _exact_sums(rows: DataFrame, dim: int, factor: float, shift: int) -> tuple[int, list[int]]:
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(dim, dtype=object)
        for _, x in _matrices(batches, dim, factor, shift):
            n += len(x)
            small = np.abs(x).max(initial=0) < 2**50  # then a batch adds up inside 64 bits
            total += (x if small else x.astype(object)).sum(axis=0).astype(object)
        yield pd.DataFrame({"i": np.arange(dim + 1), "x": [str(s) for s in (n, *total)]})

    parts = rows.select("v").mapInPandas(sums, "i int, x string")
    cells = parts.groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    found = {r["i"]: int(r["x"]) for r in cells}
    return found.get(0, 0), [found.get(k + 1, 0) for k in range(dim)]


def fit(rows: DataFrame, vector: str = "embedding", components: int = 32, factor: float = 64.0, shift: int = 1_000_000) -> Whitening | None:
    """Whitening fitted to all rows of the table; None if no component has variance."""
    rows = rows.select(F.col(vector).cast("array<double>").alias("v"))
    dim = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    if dim <= 0:
        return None
    n, sums = _exact_sums(rows, dim, factor, shift)
    if not n:
        return None
    found = Whitening(dim, n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0, factor, shift)
    v = _moments(rows, dim, dim, found.centred, factor, shift)[1:, 1:] / n
    found.trace = float(np.trace(v))
    if not found.trace > 0:
        return None
    values, vectors = leading_pairs(v, components)
    keep = values > _TINY * found.trace
    found.values, found.vectors = values[keep], vectors[:, keep]
    width = int(keep.sum())
    again = _moments(rows, dim, width, found.whitened, factor, shift)
    mean = again[0, 1:] / n  # zero but for rounding
    covariance = again[1:, 1:] / n - np.outer(mean, mean)
    found.identity_error = float(np.abs(covariance - np.eye(width)).max())
    return found


_ROWS = "{key}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, found: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector that takes part and component: the key, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema[key].dataType.simpleString()
    shape = _ROWS.format(key=f"id {kind}")
    narrow = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    if found is None:
        return narrow.sparkSession.createDataFrame([], shape).withColumnRenamed("id", key)
    width = len(found.values)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                good, x = whole_numbers(part.column(1).to_pandas(), found.dim, found.factor, found.shift)
                d = found.deviations(x)
                if d.dtype != object and len(d) and float(np.abs(d).max()) ** 2 * found.dim < 2.0**62:
                    far = pa.array((d * d).sum(axis=1))
                else:
                    wide = d.astype(object)
                    far = pa.array([s if s < 2**63 else None for s in map(int, (wide * wide).sum(axis=1))], type=pa.int64())
                owner = np.repeat(np.arange(len(good)), width)
                number = np.tile(np.arange(width), len(good))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(good[owner])),
                        pa.array((number + 1).astype(np.int32)),
                        pa.array(np.full(len(owner), found.n)),
                        far.take(pa.array(owner)),
                        pa.array(found.whitened(x).ravel()),
                        pa.array((found.values / found.trace)[number]),
                        pa.array(np.full(len(owner), found.identity_error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return narrow.mapInArrow(out, shape).withColumnRenamed("id", key)
