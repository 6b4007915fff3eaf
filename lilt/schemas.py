"""Schemas of the input and output tables. Times are BIGINT milliseconds inside, DOUBLE seconds at the edges."""

from __future__ import annotations

from pyspark.sql import types as T

from lilt.functions.documents import Field, Model

ASR_WORD = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("start_s", T.DoubleType()),
        T.StructField("end_s", T.DoubleType()),
        T.StructField("probability", T.DoubleType()),
    ]
)

ASR_SEGMENTS = T.StructType(
    [
        T.StructField("recording_id", T.LongType(), False),
        T.StructField("seg_idx", T.LongType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("no_speech_prob", T.DoubleType()),
        T.StructField("words", T.ArrayType(ASR_WORD)),
    ]
)

WORDS = T.StructType(
    [
        T.StructField("recording_id", T.LongType(), False),
        T.StructField("word_idx", T.LongType(), False),
        T.StructField("word", T.StringType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

LIVE_WORD = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

LIVE_WINDOWS = T.StructType(
    [
        T.StructField("session_id", T.LongType(), False),
        T.StructField("trigger_seq", T.LongType(), False),
        T.StructField("window_start_ms", T.LongType()),
        T.StructField("window_len_ms", T.LongType()),
        T.StructField("words", T.ArrayType(LIVE_WORD)),
    ]
)

JOB_EVENTS = T.StructType(
    [
        T.StructField("job_id", T.LongType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("write", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("progress", T.DoubleType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("completed_chunks", T.IntegerType()),
        T.StructField("current_stage", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

# Models of a result document, as stored in the JSON column of a job. Fields without a default must be there.
def _may_miss(kind) -> Field:
    return Field(kind, None, optional=True)


RESULT_WORD: Model = {
    "word": Field(str),
    "start": Field(float),
    "end": Field(float),
    "confidence": Field(float, 1.0),
    "stressed": Field(bool, False),
    "stress_score": Field(float, 0.0),
    "pause_after": Field(float, 0.0),
    "is_hesitation": Field(bool, False),
    "pitch_mean": _may_miss(float),
    "pitch_direction": _may_miss(str),
    "pitch_contour": Field([float], []),
    "mean_pitch": _may_miss(float),
    "max_pitch": _may_miss(float),
    "min_pitch": _may_miss(float),
    "start_pitch": _may_miss(float),
    "end_pitch": _may_miss(float),
    "pitch_slope": _may_miss(float),
    "pitch_range": _may_miss(float),
    "normalized_pitch": _may_miss(float),
    "pitch_trend": _may_miss(str),
    "char_pitches": _may_miss([float]),
    "voiced_segment_index": _may_miss(int),
}

RESULT_PHRASE: Model = {
    "phrase_index": Field(int),
    "text": Field(str),
    "words": Field([RESULT_WORD]),
    "start_time": Field(float),
    "end_time": Field(float),
    "chunk_index": Field(int),
    "intonation_pattern": _may_miss(str),
}

RESULT_HEADER: Model = {
    "total_duration": Field(float, 0.0),
    "word_count": Field(int, 0),
    "wpm": Field(float, 0.0),
    "stress_ratio": Field(float, 0.0),
    "pitch_variation": Field(float, 0.0),
}

JOB_RESULT: Model = {"phrases": Field([RESULT_PHRASE], []), **RESULT_HEADER}

JOB_STATUSES = ("queued", "processing", "complete", "failed")
