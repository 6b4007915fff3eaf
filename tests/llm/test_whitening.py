"""Whitening against dense eigenvectors, inertia counts against eigenvalues, and the edges of the table."""

import math

import numpy as np
import pytest

from lilt.llm import queries, whitening

SHAPE = "vec_id long, embedding array<float>, n string, component string, id string, v string, deviation string"
EXTRA = ("a",) * 5


def frame(spark, rows):
    return spark.createDataFrame([(k, v, *EXTRA) for k, v in rows], SHAPE).repartition(3)


def expected(vectors, most=32):
    """Whole numbers, deviations and whitened values by plain Python and numpy."""
    dim = max(map(len, vectors))
    x = [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (dim - len(v))]] for v in vectors]
    n = len(x)
    sums = [sum(column) for column in zip(*x)]
    deviation = [[n * a - s for a, s in zip(row, sums)] for row in x]
    y = np.array(deviation, dtype=np.float64) / n
    v = y.T @ y / n
    e, z = np.linalg.eigh(v)
    e, z = e[::-1][:most], z[:, ::-1][:, :most]
    return [sum(d * d for d in row) for row in deviation], e, y @ z / np.sqrt(e), np.trace(v)


@pytest.mark.parametrize("dim", [5, 40])
def test_whitened_rows(spark, dim):
    draw = np.random.default_rng(dim)
    spread = np.exp(-np.arange(dim) / 10)
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(draw.standard_normal((600, dim)) @ np.linalg.qr(draw.standard_normal((dim, dim)))[0] * spread + 3)]
    rows += [(5, rows[5][1]), (None, rows[9][1]), (601, [1.5]), (602, [])]  # a repeated row, no id, short vectors
    odd = [(700, None), (701, [math.nan] * dim), (702, [None] * dim), (703, [1.0] * (dim - 1) + [math.inf]), (704, [None])]
    table = frame(spark, rows + odd)
    got = whitening.whiten(table, whitening.fit(table)).collect()
    deviation, e, white, trace = expected([v for _, v in rows])
    width = min(dim, 32)
    assert len(got) == len(rows) * width and {r.n for r in got} == {len(rows)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    ids = [k for k, _ in rows]
    for c in range(width):
        mine = [r for r in got if r.component == c + 1]
        assert mine[0].explained == pytest.approx(e[c] / trace, rel=1e-9)
        assert sorted((str(r.vec_id), r.deviation) for r in mine) == sorted((str(k), d) for k, d in zip(ids, deviation))
        by_id = {r.vec_id: r.whitened for r in mine}
        sign = np.sign(by_id[0] * white[0, c])
        assert all(by_id[k] == pytest.approx(sign * white[j, c], abs=1e-7) for j, k in enumerate(ids))


def test_tables_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        table = frame(spark, rows)
        assert whitening.whiten(table, whitening.fit(table)).collect() == []
    flat = frame(spark, [(k, [float(k), 7.0, 2.0 * k]) for k in range(20)])  # one dimension's worth of variance
    got = whitening.whiten(flat, whitening.fit(flat)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)


def test_large_numbers(spark):
    table = frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])])
    got = whitening.whiten(table, whitening.fit(table)).collect()
    assert {r.deviation for r in got} == {None, 3 * 3} or all(r.deviation is None or r.deviation >= 0 for r in got)
    assert max(abs(r.whitened) for r in got) < 2


@pytest.mark.parametrize("seed", range(8))
def test_inertia(seed):
    draw = np.random.default_rng(seed)
    a = draw.standard_normal((seed + 1, seed + 1))
    a = a + a.T
    np.fill_diagonal(a, np.diag(a) * (seed % 2))
    assert whitening.positive_count(a)[0] == (np.linalg.eigvalsh(a) > 0).sum()


def test_equal_and_close_eigenvalues():
    draw = np.random.default_rng(2)
    turn, _ = np.linalg.qr(draw.standard_normal((48, 48)))
    for spectrum in ([5.0] * 20 + [1.0] * 20 + [0.0] * 8, 1 + 1e-9 * np.arange(48), np.exp(-np.arange(48.0) / 2)):
        v = turn @ np.diag(spectrum) @ turn.T
        v = (v + v.T) / 2
        e, x = whitening.leading_pairs(v, 32)
        assert np.allclose(e, np.sort(spectrum)[::-1][:32], rtol=0, atol=1e-13 * max(spectrum))
        assert np.abs(x.T @ x - np.eye(32)).max() < 1e-13 and np.abs(v @ x - x * e).max() < 1e-13 * max(spectrum)
        cuts = whitening.borders(v, 32)
        assert cuts[-1][1] >= 32 and all(a[0] > b[0] and a[1] < b[1] for a, b in zip(cuts, cuts[1:]))


def test_a_missing_pair_is_noticed():
    with pytest.raises(ArithmeticError):
        whitening.feast(np.diag([3.0, 2.0, 1.0]), 1.5, 4.0, 3)


def test_query_agrees_with_dense_eigenvectors(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pydict()
    good = [(k, v) for k, v in zip(rows["vec_id"], rows["embedding"]) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    deviation, e, white, trace = expected([v for _, v in good])
    got = {(r.vec_id, r.component): r for r in queries.QUERIES["op11_feast_whitening"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(good) * 32
    for j, (k, _) in enumerate(good):
        assert got[k, 1].deviation == deviation[j]
        for c in range(32):
            sign = np.sign(got[good[0][0], c + 1].whitened * white[0, c])
            assert got[k, c + 1].whitened == pytest.approx(sign * white[j, c], abs=1e-6)
