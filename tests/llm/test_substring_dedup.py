"""Substring dedup against plain Python, the FM-index against a dictionary of windows."""

import random
import re

import numpy as np
import pytest

from lilt.llm import substring_dedup as sub
from lilt.llm.fm_index import NOBODY, BitVector, FmIndex, WaveletMatrix

SHAPE = "doc_id long, text string, n_words long, n_removed string, anchor string, _row int, start long, words string"
EXTRA = (None, "r", "a", 1, 2, "w")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed, kinds=300):
    draw = random.Random(seed)
    return [draw.choice(["w", "É", "x ", ","]) + str(draw.randrange(kinds)) for _ in range(n)]


def expected(rows):
    words = [WORDS.findall(text or "") for _, text in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - 49):
            if doc is not None:
                key = tuple(w[i : i + 50])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 49):
            if doc is not None and first[tuple(w[i : i + 50])] < doc:
                gone.update(range(i, i + 50))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, *EXTRA) for r in rows], SHAPE).repartition(parts)
    kept = sub.dedup_substrings(frame)
    assert kept.columns == ["doc_id", "text", "anchor", "_row", "start", "words", "n_words", "n_removed"]
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in kept.collect()), key=str)


def corpus():
    base, passage, hot = prose(300, 1), prose(70, 2), prose(90, 3)
    rows = [
        (1, " ".join(base)), (2, "\t".join(base)), (2, " ".join(base)), (3, "\n".join(base[:49])), (4, " ".join(base[100:150])), (5, " ".join(base[100:149])),
        (6, " ".join(base).upper()), (7, None), (8, ""), (9, " \n\t"), (None, " ".join(base)), (10, " ".join(["same"] * 400)), (11, " ".join(["same"] * 120 + ["other"] + ["same"] * 49)),
        (12, " ".join(prose(40, 4) + passage + prose(60, 5) + passage)), (13, " ".join(passage[:60] + prose(5, 6) + passage[5:])), (0, " ".join(prose(20, 7) + passage[10:65])),
        (14, " ".join(prose(60, 8) * 3)), (15, " ".join(prose(60, 8) * 2)), (16, " ".join(prose(30_000, 9, 9000))), (17, " ".join(prose(30_000, 9, 9000)[20_000:20_400])),
        (20, " ".join(base)), (20, " ".join(base)), (-5, " ".join(base[200:])),
    ]
    for k in range(30, 130):  # a frequent passage in contexts of their own, whole, cut and with a changed word
        middle = hot[k % 7 :] if k % 3 else hot
        if k % 5 == 0:
            middle = [*middle[:40], f"new{k}", *middle[40:]]
        rows.append((k, " ".join(prose(k % 60, k) + middle + prose(30, 1000 + k))))
    return rows


@pytest.mark.parametrize(("one_in", "holders", "group", "shard"), [(64, 16, 8192, 1 << 19), (1, 5, 4, 500), (1, 10**9, 7, 2000), (1, 2, 8192, 1 << 19)])
def test_words_kept(spark, monkeypatch, one_in, holders, group, shard):
    """Whatever the sample finds frequent, and however contents are dealt to indexes, the result is the same."""
    whole = sub.frequent_grams
    monkeypatch.setattr(sub, "frequent_grams", lambda docs: whole(docs, one_in, holders))
    monkeypatch.setattr(sub, "GROUP_SEGMENTS", group)
    monkeypatch.setattr(sub, "SHARD_WORDS", shard)
    rows = corpus()
    assert found(spark, rows) == expected(rows)


def test_small_tables(spark):
    assert found(spark, []) == []
    for rows in ([(1, None)], [(None, "a b")], [(3, " ".join(prose(50, 1))), (2, " ".join(prose(50, 1)))]):
        assert found(spark, rows) == expected(rows)


def test_sliding_least():
    draw = np.random.default_rng(0)
    for width in range(1, 50):
        x = draw.integers(0, 1000, size=60).astype(np.uint64)
        assert sub.sliding_least(x, width).tolist() == [x[i : i + width].min() for i in range(60 - width + 1)]


def test_wavelet_ranks():
    draw = np.random.default_rng(1)
    symbols = draw.integers(0, 37, size=1000)
    matrix = WaveletMatrix(symbols, 37)
    at, of = draw.integers(0, 1001, size=500), draw.integers(0, 37, size=500)
    assert matrix.rank(of, at).tolist() == [(symbols[:a] == s).sum() for a, s in zip(at, of)]
    bits = draw.integers(0, 2, size=193)
    assert BitVector(bits).rank(np.arange(194)).tolist() == np.concatenate(([0], np.cumsum(bits))).tolist()


def test_first_owners():
    draw = np.random.default_rng(2)
    bounds = lambda rows: np.cumsum([0, *map(len, rows)])
    for _ in range(150):
        depth, kinds = int(draw.integers(2, 10)), int(draw.integers(2, 6))
        held = [draw.integers(1, kinds, size=draw.integers(0, 40)) for _ in range(draw.integers(1, 15))]
        owners = draw.integers(0, 30, size=len(held))
        streamed = held[:2] + [draw.integers(0, kinds, size=draw.integers(0, 40)) for _ in range(4)]
        first = {}
        for row, owner in zip(held, owners):
            for i in range(len(row) - depth + 1):
                key = tuple(row[i : i + depth].tolist())
                first[key] = min(first.get(key, NOBODY), owner)
        want = [first.get(tuple(q[i : i + depth].tolist()), NOBODY) if i + depth <= len(q) else NOBODY for q in streamed for i in range(len(q))]
        index = FmIndex(np.concatenate(held), bounds(held), owners, kinds, depth)
        assert index.first_owners(np.concatenate(streamed), bounds(streamed)).tolist() == want


def test_long_regular_words_differ(spark):
    """Words that a polynomial hash would confuse."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(k, " ".join(f"{w}{j}" for j in range(60))) for k, w in enumerate((a, b, a))]
    assert found(spark, rows) == expected(rows)
