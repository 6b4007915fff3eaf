"""Hand-made examples with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lilt.functions import pitch, timing, tokens
from lilt.operators import pauses, phrases, quality, stylize, voicing, word_pitch
from lilt.operators.stress import align_stress, normalize_labels
from lilt.plans import sessions

WORDS = "recording_id long, word_idx long, word string, start_ms long, end_ms long, confidence double"


def sentence(spark, *words):
    return spark.createDataFrame([(1, i, *w, 1.0) for i, w in enumerate(words)], WORDS)


def test_pauses(spark):
    words = sentence(
        spark, ("I", 0, 240), ("went", 320, 560), ("to", 560, 720), ("the", 1440, 1600), ("store", 1640, 2080)
    )
    rows = phrases.phrase_words(words).withColumn(
        "kind", timing.pause_class(F.col("word"), F.col("pause_after_ms"), F.col("is_last"))
    ).orderBy("word_idx").collect()
    assert [r.pause_after_ms for r in rows] == [80, 0, 720, 40, 0]
    assert [r.kind for r in rows] == ["none", "none", "medium", "none", "none"]


def test_absorption(spark):
    words = sentence(spark, ("I", 0, 200), ("um", 300, 700), ("went", 1000, 1200))
    rows = pauses.absorb_hesitations(phrases.phrase_words(words)).orderBy("word_idx").collect()
    assert [(r.word, r.pause_after_ms) for r in rows] == [("I", 800), ("went", 0)]


def test_leading_hesitation_is_kept_as_anchor(spark):
    words = sentence(spark, ("um", 0, 300), ("uh", 400, 500), ("yes", 600, 900))
    rows = pauses.absorb_hesitations(phrases.phrase_words(words)).orderBy("word_idx").collect()
    assert [(r.word, r.pause_after_ms) for r in rows] == [("um", 300), ("yes", 0)]


@pytest.mark.parametrize(
    "word,length,flag", [("Um,", 10, True), ("a", 349, False), ("a", 350, True), ("A.", 400, True), ("an", 900, False)]
)
def test_hesitations(spark, word, length, flag):
    rows = sentence(spark, (word, 0, length)).select(tokens.is_hesitation(F.col("word"), F.col("start_ms"), F.col("end_ms")))
    assert rows.first()[0] is flag


def test_false_periods(spark):
    vocabulary = spark.createDataFrame([("the",), ("we",)], "token string")
    words = sentence(
        spark,
        ("Of.", 0, 100), ("Course", 2000, 2100),      # cannot end a sentence; next word is not in the vocabulary
        ("yes.", 2200, 2300), ("no.", 4000, 4100),    # next starts in lower case
        ("The", 4500, 4600), ("end.", 4700, 4800),    # close and lower-caseable
        ("The", 5600, 5700), ("I.", 5800, 5900), ("I", 6000, 6100), ("stop.", 6200, 6300), ("We", 6400, 6500),
    )
    rows = phrases.repair_false_periods(words, vocabulary).orderBy("word_idx").collect()
    assert [r.word for r in rows] == ["Of", "Course", "yes", "no", "the", "end.", "The", "I", "I", "stop", "we"]


def test_reconstruction_closes_and_cases(spark):
    vocabulary = spark.createDataFrame([("the",)], "token string")
    words = sentence(spark, ("hello", 0, 100), ("there,", 150, 250), ("next", 1250, 1300), ("one", 1350, 1400))
    rows = phrases.reconstruct_sentences(words, vocabulary).orderBy("word_idx").collect()
    assert [r.word for r in rows] == ["Hello", "there.", "Next", "one."]
    assert [r.phrase_index for r in rows] == [0, 0, 1, 1]


def test_stress_falls_back_to_the_first_equal_text(spark):
    words = phrases.phrase_words(sentence(spark, ("go", 0, 1), ("Going", 2, 3), ("home", 4, 5), ("now", 6, 7)))
    labels = spark.createDataFrame(
        [(1, 0, 0, "home", 1), (1, 0, 1, "go", 1), (1, 0, 2, "x", 0), (1, 0, 3, "", 1)],
        "recording_id long, phrase_index long, pos long, word string, label int",
    )
    rows = align_stress(words, normalize_labels(labels)).orderBy("word_idx").collect()
    # go: label 1 by text; Going: prefix at its position; home: label 0 by text; now: an empty label matches.
    assert [r.stressed for r in rows] == [True, True, True, True]
    assert [r.stress_score for r in rows] == [1.0] * 4


def frames_of(spark, values):
    return spark.createDataFrame(
        [(1, i, None if v is None else float(v)) for i, v in enumerate(values)], "recording_id long, frame_idx long, f0 double"
    )


@pytest.fixture(scope="module")
def hundred(spark):
    values = [None] * 100
    values[10:50] = np.linspace(150, 200, 40)
    values[60:85] = np.linspace(190, 160, 25)
    return frames_of(spark, values)


@pytest.mark.parametrize("criterion", ["none", "mae", "mse"])
def test_hundred_frames(spark, hundred, criterion):
    words = sentence(spark, ("hello", 100, 350), ("world", 600, 800), ("silence", 0, 50))
    segments = voicing.voiced_segments(hundred)
    assert segments.count() == 2
    styled = stylize.stylize_segments(stylize.with_piece_count(segments), criterion)
    assert stylize.full_contour(hundred, styled).filter("value is not null").count() == 65
    rows = sessions.pitch_features(words, hundred, criterion).orderBy("word_idx").collect()
    assert [r.pitch_trend for r in rows] == [pitch.RISING, pitch.FALLING, None]
    assert len(rows[0].char_pitches) == 5 and rows[2].char_pitches is None and rows[2].mean_pitch is None
    assert [r.voiced_segment_index for r in rows] == [0, 1, None]
    assert rows[0].start_pitch == pytest.approx(150.0) and rows[1].start_pitch == pytest.approx(190.0)


def test_contours_of_words(spark, hundred):
    words = sentence(spark, ("hello", 100, 350), ("across.", 300, 700), ("it", 0, 990), ("a", 100, 400), ("gap", 500, 590))
    tones = word_pitch.word_intonation(phrases.phrase_words(words), hundred, 10).orderBy("word_idx").collect()
    assert [len(r.pitch_contour) for r in tones] == [5, 7, 2, 1, 0]
    track = [r.f0 for r in hundred.orderBy("frame_idx").collect()]
    for r in tones:
        inside = list(enumerate(track))[-(-r.start_ms // 10) : r.end_ms // 10 + 1]
        known = [(k, v) for k, v in inside if v is not None]
        if len(known) < 2:
            continue
        filled = np.interp([k for k, _ in inside], *zip(*known))
        n = len(r.pitch_contour)
        want = np.interp(np.arange(n) * (len(filled) - 1) / max(n - 1, 1), np.arange(len(filled)), filled)
        assert r.pitch_contour == pytest.approx(want.tolist())


def test_runs_at_the_edges_and_short_runs(spark):
    frames = frames_of(spark, [100, 100, None, 120, 120, 120, None] + [150] * 9)
    kept = voicing.clean_short_runs(frames).filter("f0 is not null").select("frame_idx")
    assert sorted(r[0] for r in kept.collect()) == [3, 4, 5, *range(7, 16)]
    rows = voicing.voiced_segments(frames).collect()
    assert [(r.start_frame, r.end_frame, r.segment_index) for r in rows] == [(7, 15, 0)]


def test_split_run_gives_the_remainder_to_the_last_piece(spark):
    rows = voicing.voiced_segments(frames_of(spark, [100 + i for i in range(50)]), max_len=24).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame) for r in rows] == [(0, 15), (16, 31), (32, 49)]


def test_gap_filling(spark):
    rows = voicing.fill_gaps(frames_of(spark, [None, 100, None, None, 160, None])).orderBy("frame_idx").collect()
    assert [r.f0_filled for r in rows] == pytest.approx([100, 100, 120, 140, 160, 160])


def test_sentence_patterns(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, "rising"), (1, 1, 0, "unvoiced"), (1, 2, 0, "falling"), (1, 3, 1, "falling"), (1, 4, 2, "unvoiced")],
        "recording_id long, word_idx long, phrase_index long, pitch_direction string",
    )
    found = {r.phrase_index: r.intonation_pattern for r in word_pitch.sentence_intonation(rows).collect()}
    assert found == {0: "rise-fall", 1: "falling", 2: "flat"}


def test_unvoiced_marks_become_null(spark):
    rows = spark.createDataFrame([(0.0,), (float("nan"),), (120.0,), (None,)], "f0 double")
    assert [r[0] for r in rows.select(pitch.voiced_or_null(F.col("f0"))).collect()] == [None, None, 120.0, None]


def test_tone(spark):
    row = quality.tone_check(frames_of(spark, [199, 201, None])).first()
    assert row.within and row.mean_f0 == pytest.approx(200)


def test_phrases_of_any_length_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE_WORDS", 4)
    words = sentence(spark, *[(f"w{i}", 10 * i, 10 * i + 5) for i in range(10)])
    rows = phrases.build_phrases(phrases.phrase_words(words)).orderBy("first_pos").collect()
    assert [len(r.words) for r in rows] == [4, 4, 2]
    assert {(r.n_words, r.start_ms, r.end_ms) for r in rows} == {(10, 0, 95)}
    assert " ".join(r.text for r in rows) == " ".join(f"w{i}" for i in range(10))
