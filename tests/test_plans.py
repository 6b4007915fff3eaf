"""Physical plans: pushdown, pruning, and no plan that pairs everything with everything."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from lilt import fixtures as fx
from lilt.operators import audio, jobs, phrases, scan, stress, word_pitch

SF = "/root/testdata/sf0.001"
# Queries whose construction runs a stream or a long job; their plans read written tables.
HEADS = [
    "session_overview", "agg1_session_summary", "jn3_words_x_frames", "jn4_word_in_segment", "jn5_slice_audio_by_phrase",
    "prj15_peak_gain", "win1_pause_after", "win3_false_period_cleanup", "agg12_octave_histogram", "st2_sliding_context_window",
]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEADS)
def test_no_pairing_joins(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_point_lookup_reaches_the_scan(spark):
    text = plan(jobs.find_job(jobs.job_state(fx.job_events(spark, SF)), 7))
    assert re.search(r"PushedFilters: \[.*EqualTo\(job_id,7\)", text)


def test_scans_read_only_what_they_need(spark):
    text = plan(phrases.group_by_punctuation(fx.words(spark, SF)).select("recording_id", "phrase_index"))
    assert "confidence" not in text and "end_ms" not in text


def test_pause_needs_one_shuffle_of_the_words(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(phrases.phrase_words(fx.words(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Neighbours and phrase numbers share one partitioning: between the two joins of carries the rows meet no exchange.
    lines = [line.replace(":", " ").replace("+-", "  ").replace("*", " ") for line in text.split("\n")]
    joins = [k for k, line in enumerate(lines) if "SortMergeJoin" in line]
    between = lines[joins[0] + 1 : joins[1]]
    assert between and not any("Exchange" in line for line in between)


def test_interval_join_is_an_equi_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = fx.pitch_frames(spark, SF).select("recording_id", "frame_idx", "f0")
        text = plan(word_pitch.words_x_frames(fx.frame_words(spark, SF), frames))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"SortMergeJoin \[recording_id#\d+L, _cell#\d+L\]", text)


def test_wide_rows_are_not_joined_by_recording(spark):
    """Samples, contents and texts meet carries by block or chunk; a recording may hold a third of all rows."""
    words = fx.words(spark, SF).select("recording_id", "word_idx", F.col("word").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = plan(scan.text_pieces(words, ["recording_id"], "word_idx"))
        chunks = plan(audio.concat_chunks(fx.audio_chunks(spark, SF)))
        gains = plan(audio.peak_gain(fx.pcm_blocks(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    alone = re.compile(r"SortMergeJoin \[recording_id#\d+L?\], ")
    assert not alone.search(texts) and not alone.search(chunks)
    # The gain is looked up for (recording, stretch) pairs, which carry no samples.
    (join,) = [k for k, line in enumerate(gains.split("\n")) if alone.search(line)]
    assert "samples" not in gains.split("\n")[join + 1] and re.search(r"SortMergeJoin \[recording_id#\d+L, _spread#\d+L?\]", gains)
    # Contents pass one exchange, that of their chunk.
    assert len(re.findall(r"hashpartitioning\(recording_id#\d+L, seq#\d+L", chunks)) <= 2


def test_oracles_have_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_lines_are_read_once_for_each_kind(spark):
    """Documents read back: no filter pushed below the reading parses and types the lines again."""
    text = plan(contract.queries()["snk1_document_round_trip"](spark, SF))
    assert text.count("parseJson(") == 2


def test_words_with_a_fitting_label_are_not_moved_for_lookups(spark):
    """Only words whose label at their place does not fit go to the exchange that looks texts up."""
    words = spark.createDataFrame(
        [(1, 0, p, w) for p, w in enumerate(["So", "we", "went", "we", None, "on", "off"])] + [(1, 1, 0, "on")],
        "recording_id long, phrase_index long, pos long, word string",
    )
    labels = spark.createDataFrame(
        [(1, 0, 0, "so,", True), (1, 0, 1, "x", False), (1, 0, 2, "we", True), (1, 0, 4, "on", True), (1, 0, 5, "zz", False), (1, 0, 6, "", True)],
        "recording_id long, phrase_index long, pos long, word string, stressed boolean",
    ).withColumn("stress_score", F.when(F.col("stressed"), 1.0).otherwise(0.0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = stress.align_stress(words, labels)
        text = plan(found)
        rows = {(r.phrase_index, r.pos): (r.stressed, r.stress_score) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    yes, no = (True, 1.0), (False, 0.0)
    assert rows == {(0, 0): yes, (0, 1): yes, (0, 2): yes, (0, 3): yes, (0, 4): no, (0, 5): yes, (0, 6): yes, (1, 0): no}
    lines = text.split("\n")
    lookups = [k for k, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\([^)]*_spread", line) and "_hit" not in line]
    assert lookups and any("NOT coalesce" in line and "StartsWith" in line for line in lines)
