"""What stays on disk: shuffle files behind written tables, and how often words are moved."""

import re
import time

import __spark_entry__ as contract
from lilt.operators import stress, summary
from lilt.operators.phrases import PIECE_WORDS
from lilt.session import cut, staged

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(k).getName() for k in range(found.size())) if re.match(r"shuffle_.*\.data", name)}


def left_over(spark, before, wait=20):
    """Shuffle files that are still there after a while; they are deleted in the background."""
    until = time.time() + wait
    while (new := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return new


def test_written_tables_leave_no_shuffle_files(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id")
    sums = rows.groupBy("k").sum("id")
    before = shuffle_files(spark)
    kept = cut(sums, "sums")
    assert shuffle_files(spark) - before  # else the test sees nothing
    before = shuffle_files(spark)
    tidied = cut(sums, "sums", tidy=True)
    assert not left_over(spark, before)
    derived = staged(spark, "sums", "test-disk", lambda: sums)
    assert not left_over(spark, before)
    assert sorted(kept.collect()) == sorted(tidied.collect()) == sorted(derived.collect())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved_words(text):
    """Exchanges that carry the words of a document."""
    lines = text.split("\n")
    below = lambda k: " ".join(lines[k + 1 : k + 3])
    return sum("Exchange hashpartitioning" in line and re.search(r"\bwords#|collect_list\(", below(k)) is not None for k, line in enumerate(lines))


def test_document_json_reads_aligned_words_that_are_written_once(spark):
    """Words and labels meet in no plan that reads them more than once."""
    text = physical(contract.queries()["snk1_document_json"](spark, SF))
    assert "_label#" not in text and "_token#" not in text


def test_round_trip_reads_its_lines_from_a_table(spark):
    text = physical(contract.queries()["snk1_document_round_trip"](spark, SF))
    assert "_label#" not in text and "_token#" not in text
    assert "-lines-" in text and "collect_list" not in text


def test_phrases_move_their_words_once(spark):
    words = spark.createDataFrame([(1, 0, 0, "so", 0, 5, 1.0)], "recording_id long, phrase_index long, pos long, word string, start_ms long, end_ms long, confidence double")
    chunks = spark.createDataFrame([(1, 0, 0)], "recording_id long, phrase_index long, chunk_index long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = physical(summary.result_phrases(words, chunks=chunks))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved_words(text) == 1


def test_pieces_of_a_phrase_share_its_bounds_pattern_and_chunk(spark):
    """A phrase of three pieces with a repeated word, one of a single word, one without chunk, one without a key."""
    n = 2 * PIECE_WORDS + 3
    long = [(1, 0, p, f"w{p}", 10 * p, 10 * p + 5, 1.0) for p in range(n)]
    rows = [*long, long[7], (1, 1, 0, "one", 7, 9, None), (2, 0, 0, None, 1, 2, 0.5), (None, 0, 0, "x", 1, 2, 0.5)]
    words = spark.createDataFrame(rows, "recording_id long, phrase_index long, pos long, word string, start_ms long, end_ms long, confidence double")
    chunks = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], "recording_id long, phrase_index long, chunk_index long")
    patterns = spark.createDataFrame([(1, 1, "rise")], "recording_id long, phrase_index long, intonation_pattern string")
    found = summary.result_phrases(words, patterns, chunks).collect()
    end = round((10 * (n - 1) + 5) / 1000, 3)
    facts = sorted((r.recording_id, r.phrase_index, r.first_pos, len(r.words), r.start_time, r.end_time, r.n_words, r.intonation_pattern, r.chunk_index or -1) for r in found)
    assert facts == [
        (1, 0, 0, PIECE_WORDS + 1, 0.0, end, n + 1, "flat", 5),
        (1, 0, PIECE_WORDS, PIECE_WORDS, 0.0, end, n + 1, "flat", 5),
        (1, 0, 2 * PIECE_WORDS, 3, 0.0, end, n + 1, "flat", 5),
        (1, 1, 0, 1, 0.007, 0.009, 1, "rise", 6),
        (2, 0, 0, 1, 0.001, 0.002, 1, "flat", -1),
    ]


def test_written_alignment_gives_the_same_rows(spark):
    """Also for labels that come twice, words that are NULL and phrases without labels."""
    words = spark.createDataFrame(
        [(1, 0, p, w) for p, w in enumerate(["So", "we", "went", "we", None, "on", "off"])] + [(1, 0, 1, "we"), (1, 1, 0, "on"), (None, 0, 0, "so")],
        "recording_id long, phrase_index long, pos long, word string",
    )
    labels = spark.createDataFrame(
        [(1, 0, 0, "so,", 1), (1, 0, 1, "x", 0), (1, 0, 1, "we", 0), (1, 0, 2, "we", 1), (1, 0, 4, "on", 1), (1, 0, 5, None, 1), (1, 0, 6, "", None)],
        "recording_id long, phrase_index long, pos long, word string, label int",
    )
    given = stress.normalize_labels(labels)
    rows = lambda df: sorted(map(repr, df.collect()))
    plain, written = stress.align_stress(words, given), stress.align_stress(words, given, written=True)
    assert written.columns == plain.columns and rows(written) == rows(plain)
    assert "StartsWith" in physical(plain) and "StartsWith" not in physical(written)
