"""Greedy breaks against a plain fold, with blocks small enough to cross many borders."""

import random

import pytest

from lilt.operators.chain import bounded_spans, clause_breaks
from lilt.operators import chunks


def clause_fold(flags):
    taken, n = [], 0
    for i, flag in enumerate(flags):
        n += 1
        if flag == 2:
            n = 0
        elif flag == 1 and n >= 30:
            taken.append(i)
            n = 0
    return taken


@pytest.mark.parametrize("rows,fan", [(16, 2), (37, 3), (64, 1000), (1 << 16, 4)])
def test_clause_breaks(spark, rows, fan):
    rng = random.Random(rows)
    weights = {1: (90, 8, 2), 2: (50, 50, 0), 3: (100, 0, 0), 4: (97, 3, 0), 5: (0, 100, 0), 6: (80, 0, 20)}
    flags = {k: rng.choices([0, 1, 2], w, k=rng.randint(150, 500)) for k, w in weights.items()}
    frame = spark.createDataFrame(
        [(k, i, f) for k, fs in flags.items() for i, f in enumerate(fs)], "recording_id long, word_idx long, _flag int"
    )
    got = sorted((r.recording_id, r.word_idx) for r in clause_breaks(frame, rows, fan).collect())
    assert got == sorted((k, i) for k, fs in flags.items() for i in clause_fold(fs))


def span_fold(segments, pause, target):
    starts, group, before = [], None, None
    for start, end in segments:
        if group is None or start - before >= pause or end - group > target:
            group = start
        starts.append(group)
        before = end
    return starts


@pytest.mark.parametrize("block,fan", [(60, 2), (100, 3), (100_000, 5)])
def test_bounded_spans(spark, block, fan):
    rng = random.Random(block)
    data = {}
    for key in range(6):
        at, rows = rng.randint(0, 30), []
        for _ in range(rng.randint(1, 200)):
            length = rng.choice([2, 3, 5, 9, 40 if key == 2 else 4])
            rows.append((at, at + length))
            at += length + rng.choice([1, 1, 2, 3] if key % 2 else [1, 2, 5, 12, 150])
        data[key] = rows
    frame = spark.createDataFrame(
        [(k, s, e, i, 0) for k, rows in data.items() for i, (s, e) in enumerate(rows)],
        "recording_id long, start_sample long, end_sample long, seg_idx long, part long",
    )
    got = sorted((r.recording_id, r.seg_idx, r.group_start) for r in bounded_spans(frame, 12, 25, block, fan).collect())
    want = sorted((k, i, g) for k, rows in data.items() for i, g in enumerate(span_fold(rows, 12, 25)))
    assert got == want


def test_silences_below_the_closing_pause_give_one_chunk(spark):
    """Five seconds of speech with one-second silences: padding leaves 0.7 s gaps, below 1.2 s."""
    second = 16_000
    segments = spark.createDataFrame(
        [(1, i, 2 * i * second, (2 * i + 1) * second) for i in range(5)],
        "recording_id long, seg_idx long, start_sample long, end_sample long",
    )
    recordings = spark.createDataFrame([(1, 10_000, 16_000)], "recording_id long, duration_ms long, sample_rate int")
    rows = chunks.merge_chunks(chunks.pad_and_split(segments, recordings)).collect()
    assert [(r.start_ms, r.end_ms, r.n_segments) for r in rows] == [(0, 9150, 5)]


def test_overlong_segment_is_cut_equally(spark):
    segments = spark.createDataFrame([(1, 0, 0, 60 * 16_000)], "recording_id long, seg_idx long, start_sample long, end_sample long")
    recordings = spark.createDataFrame([(1, 60_000, 16_000)], "recording_id long, duration_ms long, sample_rate int")
    rows = chunks.pad_and_split(segments, recordings).orderBy("part").collect()
    assert [(r.start_sample, r.end_sample) for r in rows] == [(0, 320_000), (320_000, 640_000), (640_000, 960_000)]
