"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lilt import fixtures as fx  # noqa: E402
from lilt.plans.catalog import QUERIES  # noqa: E402
from lilt.session import build_session  # noqa: E402

HEADLINE = [
    "session_overview",
    "jn1_stress_align",
    "jn3_words_x_frames",
    "agg1_session_summary",
    "agg3_phrase_build",
    "agg4_word_pitch_features",
    "agg5_word_intonation",
    "agg9_job_state",
    "win1_pause_after",
    "win3_false_period_cleanup",
    "win4_reconstruct_sentences",
    "win5_absorb_hesitations",
    "win7_voiced_segments",
    "win9_merge_speech_chunks",
    "win12_running_partial_results",
    "arr1_fill_gaps_linear",
    "arr6_piecewise_stylize_mae",
    "snk1_result_document",
    "st1_live_word_dedup",
    "st8_progress_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    began = time.time()
    for derive in (fx.words, fx.phrased, fx.staged_segments, fx.pitch_frames, fx.job_events, fx.audio_chunks, fx.live_events):
        derive(spark, sf_dir)
    staging = time.time() - began

    seconds = {}
    for name in names:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "derive_inputs_sec": round(staging, 3),
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
