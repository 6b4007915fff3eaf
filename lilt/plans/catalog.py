"""Query catalogue: one entry per operator over the driver tables, with the SQL that checks it where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lilt import fixtures as fx
from lilt.functions import contour as contour_fn
from lilt.functions import pitch as pitch_fn
from lilt.functions import timing, tokens
from lilt.operators import (
    audio,
    chunks,
    jobs,
    pauses,
    phrases,
    quality,
    stress,
    stylize,
    summary,
    voicing,
    word_pitch,
)
from lilt.plans import oracle_tables as ot
from lilt.plans import sessions, streams
from lilt.plans.hooks import model_hook
from lilt.plans.oracle_tables import chunk_sql, clean, ends, hesitates, lower_head, pieces_of_runs, sql
from lilt.schemas import JOB_STATUSES
from lilt.session import cut
from lilt.sources import asr, documents, recordings
from lilt.streaming import gate, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
C = F.col


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check:
            ORACLES[name] = check
        return fn

    return register


def r6(column: str):
    return F.round(column, 6).alias(column)


# ---- sources and sinks -------------------------------------------------------------------------------------------


@query(
    "src2_pcm_decode",
    sql(
        """SELECT recording_id, seq, len(v) AS n_samples, round(list_max(v) / 32768.0, 6) AS peak, round(list_min(v) / 32768.0, 6) AS trough
        FROM (SELECT recording_id, seq, [CASE WHEN u >= 32768 THEN u - 65536 ELSE u END FOR u IN us] AS v
          FROM (SELECT recording_id, seq, [CAST('0x' || substr(h, CAST(4 * i + 3 AS BIGINT), 2) || substr(h, CAST(4 * i + 1 AS BIGINT), 2) AS INTEGER)
              FOR i IN range(0, len(h) // 4)] AS us
            FROM (SELECT recording_id, seq, hex(encode(content)) AS h FROM chunk_texts)))""",
        "chunk_texts",
    ),
)
def _(spark, d):
    blocks = recordings.decode_pcm(fx.audio_chunks(spark, d).filter(C("kind") == "audio"))
    return blocks.select("recording_id", "seq", F.size("samples").cast("bigint").alias("n_samples"),
                         r6_expr(F.array_max("samples"), "peak"), r6_expr(F.array_min("samples"), "trough"))


def r6_expr(column, name):
    return F.round(column.cast("double"), 6).alias(name)


@query(
    "src3_scan_asr_segments",
    sql(
        """SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY word_idx) - 1 AS word_idx, turn AS seg_idx,
        word, start_ms, end_ms, confidence FROM words WHERE (recording_id * 31 + turn * 17) % 100 <= 85""",
        "words",
    ),
)
def _(spark, d):
    return asr.explode_words(fx.asr_segments(spark, d))


@query(
    "src4_scan_jobs",
    sql("SELECT job_id, status, progress, current_stage, error FROM job_state WHERE job_id = 100", "job_state"),
)
def _(spark, d):
    state = jobs.job_state(fx.job_events(spark, d))
    return jobs.find_job(state, 100).select("job_id", "status", "progress", "current_stage", "error")


# What the fixture's keys say about a job's document: none, the default, the typed values with phrases.
DOCUMENT_KIND = """SELECT job_id, status, job_id % 83 = 0 AND job_id % 97 <> 0 AND job_id % 89 <> 0 AS loose, CASE
    WHEN status = 'processing' THEN CASE WHEN job_id % 5 = 0 THEN 'none' ELSE 'partial' END WHEN status <> 'complete' THEN 'none'
    WHEN job_id % 97 = 0 THEN 'none' WHEN job_id % 89 = 0 THEN 'default' WHEN job_id % 83 = 0 THEN 'loose' WHEN job_id % 79 = 0 THEN 'none'
    WHEN job_id % 71 = 0 THEN 'default' WHEN job_id % 3 = 0 THEN CASE WHEN job_id % 73 = 0 THEN 'default' ELSE 'phrases' END
    ELSE 'plain' END AS kind FROM job_state"""


@query(
    "src5_parse_result_json",
    sql(
        f"""SELECT job_id, status, CASE kind WHEN 'none' THEN NULL WHEN 'default' THEN 0 WHEN 'partial' THEN 1 WHEN 'loose' THEN 12
          ELSE job_id % 1000 END::BIGINT AS word_count,
        CASE WHEN kind = 'none' THEN NULL WHEN kind IN ('default', 'partial') THEN 0.0 WHEN kind = 'loose' THEN 2.5 ELSE job_id % 600 + 0.5 END::DOUBLE
          AS total_duration, CASE WHEN kind <> 'none' THEN 0.0::DOUBLE END AS wpm,
        CASE WHEN kind = 'none' THEN NULL WHEN kind = 'phrases' THEN 2 ELSE 0 END::BIGINT AS n_phrases FROM ({DOCUMENT_KIND})""",
        "job_state",
    ),
)
def _(spark, d):
    parsed = jobs.parse_results(jobs.job_state(fx.job_events(spark, d)))
    return parsed.select(
        "job_id", "status", "document.word_count", "document.total_duration", "document.wpm",
        F.when(C("document").isNotNull(), F.size("document.phrases")).cast("bigint").alias("n_phrases"),
    )


@query(
    "src5_result_words",
    sql(
        f"""SELECT job_id, p AS phrase_index, 'w' || (job_id % 7) || ' v' AS text, p + 0.5::DOUBLE AS start_time, 9.0::DOUBLE AS end_time, p AS chunk_index,
        w AS pos, CASE w WHEN 0 THEN 'w' || (job_id % 7) ELSE 'v' END AS word, CASE w WHEN 0 THEN p + 0.5 ELSE 1.25 END::DOUBLE AS start,
        CASE w WHEN 0 THEN p + 0.75 ELSE 1.5 END::DOUBLE AS "end", CASE w WHEN 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, w = 0 AS stressed,
        0.0::DOUBLE AS pause_after, NULL::DOUBLE AS mean_pitch
        FROM ({DOCUMENT_KIND}), (VALUES (0), (1)) a(p), (VALUES (0), (1)) b(w) WHERE kind = 'phrases'""",
        "job_state",
    ),
)
def _(spark, d):
    """Phrases and words of the parsed documents, with the fields that the stored words leave to their defaults."""
    parsed = jobs.parse_results(jobs.job_state(fx.job_events(spark, d)))
    spoken = parsed.select("job_id", F.explode("document.phrases").alias("p")).select("job_id", "p.*")
    fields = ("word", "start", "end", "confidence", "stressed", "pause_after", "mean_pitch")
    return spoken.select(
        "job_id", "phrase_index", "text", "start_time", "end_time", "chunk_index", F.posexplode("words").alias("pos", "w")
    ).select("job_id", "phrase_index", "text", "start_time", "end_time", "chunk_index", "pos", *[C("w")[f].alias(f) for f in fields])


@query(
    "src6_concat_session_audio",
    sql(
        """SELECT recording_id, seq, md5(content) AS digest, strlen(content)::BIGINT AS n_bytes,
        coalesce(sum(strlen(content)) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
        sum(strlen(content)) OVER (PARTITION BY recording_id)::BIGINT AS total_bytes FROM chunk_texts""",
        "chunk_texts",
    ),
)
def _(spark, d):
    return audio.concat_chunks(fx.audio_chunks(spark, d)).select(
        "recording_id", "seq", "n_bytes", "offset", "total_bytes", F.md5("content").alias("digest")
    )


def _containers(spark, d):
    """Pages as containers: each paragraph opens a cluster; the page itself starts with a header."""
    marked = F.concat(F.unhex(F.lit(recordings.HEADER_MARKER)), F.encode(
        F.replace("html", F.lit("<p>"), F.decode(F.unhex(F.lit(recordings.CLUSTER_MARKER)), "ISO-8859-1")), "ISO-8859-1"))
    return fx.table(spark, d, "pages").select(C("page_id").alias("file_id"), marked.alias("content"))


@query(
    "src7_container_marker_scan",
    """SELECT page_id AS file_id, i - 2 AS span_idx, n AS n_bytes, CAST(e - n AS BIGINT) AS position FROM (SELECT page_id, i,
      length(piece) + 4 AS n, sum(length(piece) + 4) OVER (PARTITION BY page_id ORDER BY i) AS e
      FROM (SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
        FROM (SELECT page_id, string_split(html, '<p>') AS p FROM pages))) WHERE i > 1""",
)
def _(spark, d):
    return recordings.marker_spans(_containers(spark, d), "file_id").select(
        "file_id", "span_idx", C("position").cast("bigint").alias("position"), C("n_bytes").cast("bigint").alias("n_bytes")
    )


@query("src7_header_count", "SELECT page_id AS file_id, 1 AS n_markers FROM pages")
def _(spark, d):
    return recordings.marker_count(_containers(spark, d), "file_id")


def _document(spark, d):
    return summary.result_phrases(_featured(spark, d))


@query(
    "snk1_result_document",
    sql(
        """SELECT recording_id, phrase_index, pos, word, round(start_ms / 1000.0, 3) AS start, round(end_ms / 1000.0, 3) AS "end", confidence, stressed,
        round(stress_score, 3) AS stress_score, round(pause_after_ms / 1000.0, 3) AS pause_after, round(min(start_ms) OVER p / 1000.0, 3) AS start_time,
        round(arg_max(end_ms, pos) OVER p / 1000.0, 3) AS end_time, count(*) OVER p AS n_words, 'flat' AS intonation_pattern
        FROM stressed WINDOW p AS (PARTITION BY recording_id, phrase_index)""",
        "stressed",
    ),
)
def _(spark, d):
    rows = _document(spark, d)
    return rows.select("recording_id", "phrase_index", "start_time", "end_time", "n_words", "intonation_pattern", F.inline("words")).drop("is_hesitation")


@query(
    "snk1_document_json",
    sql(
        """SELECT recording_id, count(*) AS word_count, sum(CASE WHEN stressed THEN 1 ELSE 0 END)::BIGINT AS n_stressed,
        count(DISTINCT phrase_index) AS n_phrases, count(*) AS n_words FROM stressed GROUP BY 1""",
        "stressed",
    ),
)
def _(spark, d):
    """The JSON lines read back by their types and summed up."""
    featured = _featured(spark, d, written=True)
    phrase_rows = summary.result_phrases(featured)
    recordings_seen = featured.groupBy("recording_id").agg(F.max("end_ms").alias("duration_ms"))
    header = summary.result_header(summary.session_summary(featured, recordings_seen))
    lines = documents.as_json(header, phrase_rows)
    typed = lambda frame: T.StructType([f for f in frame.schema if f.name != "recording_id"])
    heads = lines.where("line_kind = 'header'").select("recording_id", F.from_json("line", typed(header)).alias("h"))
    body = lines.where("line_kind = 'phrase'").select("recording_id", F.from_json("line", typed(phrase_rows)).alias("p"))
    sums = body.groupBy("recording_id").agg(
        F.sum(F.size(F.filter("p.words", lambda w: w["stressed"]))).cast("bigint").alias("n_stressed"),
        F.countDistinct("p.phrase_index").alias("n_phrases"),
        F.sum(F.size("p.words")).cast("bigint").alias("n_words"),
    )
    return heads.select("recording_id", "h.word_count").join(sums, "recording_id")


@query(
    "snk1_document_round_trip",
    sql(
        """SELECT recording_id, phrase_index, phrase_index // 3 AS chunk_index, pos, word, round(start_ms / 1000.0, 3) AS start,
        round(end_ms / 1000.0, 3) AS "end", confidence, stressed, coalesce(round(stress_score, 3), 0) AS stress_score,
        coalesce(round(pause_after_ms / 1000.0, 3), 0) AS pause_after, round(min(start_ms) OVER p / 1000.0, 3) AS start_time,
        round(arg_max(end_ms, pos) OVER p / 1000.0, 3) AS end_time, 'flat' AS intonation_pattern, count(*) OVER (PARTITION BY recording_id) AS word_count
        FROM stressed WINDOW p AS (PARTITION BY recording_id, phrase_index)""",
        "stressed",
    ),
)
def _(spark, d):
    """Documents written as JSON lines and read back by the models of the result, down to the words."""
    featured = _featured(spark, d, written=True)
    in_chunks = featured.select("recording_id", "phrase_index").distinct().withColumn("chunk_index", F.expr("phrase_index div 3"))
    ends = featured.groupBy("recording_id").agg(F.max("end_ms").alias("duration_ms"))
    header = summary.result_header(summary.session_summary(featured, ends))
    lines = documents.as_json(header, summary.result_phrases(featured, chunks=in_chunks), nulls=False)
    read = documents.parse_lines(cut(lines, "lines", "zstd", tidy=True))
    heads = read.where("line_kind = 'header'").select("recording_id", "header.word_count")
    spoken = read.where("line_kind = 'phrase'").select("recording_id", "first_pos", "phrase.*")
    fields = ("word", "start", "end", "confidence", "stressed", "stress_score", "pause_after")
    # The inner form filters by the size of the words first, for which a line would be read five times.
    return spoken.select(
        "recording_id", "phrase_index", "chunk_index", "start_time", "end_time", "intonation_pattern", "first_pos", F.posexplode_outer("words").alias("at", "w")
    ).where("at IS NOT NULL").select(
        "recording_id", "phrase_index", "chunk_index", "start_time", "end_time", "intonation_pattern", (C("first_pos") + C("at")).alias("pos"),
        *[C("w")[f].alias(f) for f in fields],
    ).join(heads.hint("rebalance"), "recording_id")


@query(
    "snk2_append_job_event",
    sql(
        """SELECT job_id, 1 AS seq, created_at + INTERVAL 1 DAY AS event_ts, 'status' AS write, 'processing' AS status,
        job_id % 7 + 1 AS total_chunks FROM job_state WHERE status = 'queued'""",
        "job_state",
    ),
)
def _(spark, d):
    queued = jobs.job_state(fx.job_events(spark, d)).filter(C("status") == "queued").withColumn("seq", F.lit(1))
    writes = jobs.status_events(
        queued, "processing", at=C("created_at") + F.expr("INTERVAL '1' DAY"), total_chunks=C("job_id") % 7 + 1
    )
    return writes.select("job_id", "seq", "event_ts", "write", "status", "total_chunks")


@query(
    "snk2_append_and_fold",
    sql(
        """SELECT * REPLACE (CASE WHEN status = 'queued' THEN 'processing' ELSE status END AS status,
          CASE WHEN status = 'queued' THEN (job_id % 7 + 1)::INTEGER ELSE total_chunks END AS total_chunks,
          CASE WHEN status = 'queued' THEN created_at + INTERVAL 1 DAY ELSE started_at END AS started_at,
          CASE WHEN status = 'queued' THEN created_at + INTERVAL 1 DAY ELSE first_started_at END AS first_started_at) FROM job_state""",
        "job_state",
    ),
)
def _(spark, d):
    return streams.appended_jobs(spark, d)


@query(
    "snk3_incremental_words_sink",
    sql("SELECT session_id, n AS trigger_seq, list_aggregate([x.word FOR x IN fresh], 'string_agg', ' ') AS text,"
        " 'incremental_words' AS type, false AS replace_words FROM cursor_walk WHERE len(fresh) > 0", "cursor_walk"),
)
def _(spark, d):
    sent = streams.live_messages(spark, d)
    body = F.from_json("message", "type string, replace_words boolean, text string")
    return sent.select("session_id", "trigger_seq", body.alias("m")).select("session_id", "trigger_seq", "m.*")


# ---- projections and filters -------------------------------------------------------------------------------------


@query("prj1_clean_token", sql(f"SELECT recording_id, word_idx, {clean('word')} AS token FROM words", "words"))
def _(spark, d):
    return fx.words(spark, d).select("recording_id", "word_idx", tokens.clean_token(C("word")).alias("token"))


@query("prj2_clean_token_weak", sql("SELECT recording_id, word_idx, lower(trim(word)) AS token FROM words", "words"))
def _(spark, d):
    return fx.words(spark, d).select("recording_id", "word_idx", tokens.clean_token_weak(C("word")).alias("token"))


@query(
    "prj3_offset_times",
    chunk_sql(
        """SELECT recording_id, chunk_index, word_idx, start_ms, end_ms FROM (SELECT w.recording_id, c.chunk_index, w.word_idx,
        w.start_ms, w.end_ms, w.start_ms * 16 <= c.end_sample AS inside FROM words w ASOF JOIN chunk_rows c
        ON w.recording_id = c.recording_id AND w.start_ms * 16 >= c.start_sample) WHERE inside"""
    ),
)
def _(spark, d):
    rows = _chunk_words(spark, d)
    return phrases.merge_chunk_words(rows, _chunks(spark, d)).select(
        "recording_id", "chunk_index", "word_idx", "start_ms", "end_ms"
    )


@query(
    "flt1_drop_no_speech",
    """SELECT conv_id AS recording_id, turn AS seg_idx, (conv_id * 31 + turn * 17) % 100 / 100.0 AS no_speech_prob
    FROM conversations WHERE (conv_id * 31 + turn * 17) % 100 <= 85""",
)
def _(spark, d):
    return asr.drop_no_speech(fx.asr_segments(spark, d)).select("recording_id", "seg_idx", "no_speech_prob")


@query(
    "prj4_segment_text",
    r"""SELECT recording_id, seg_idx, text,
      coalesce(sum(length(text) + 1) OVER (PARTITION BY recording_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
      (sum(length(text) + 1) OVER (PARTITION BY recording_id) - 1)::BIGINT AS total_chars
    FROM (SELECT conv_id AS recording_id, turn AS seg_idx, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text
      FROM conversations WHERE (conv_id * 31 + turn * 17) % 100 <= 85)""",
)
def _(spark, d):
    return asr.segment_text(fx.asr_segments(spark, d))


@query(
    "prj5_hesitation_flag",
    sql(f"SELECT recording_id, word_idx, {hesitates('word', 'end_ms - start_ms')} AS is_hesitation FROM words", "words"),
)
def _(spark, d):
    flag = tokens.is_hesitation(C("word"), C("start_ms"), C("end_ms"))
    return fx.words(spark, d).select("recording_id", "word_idx", flag.alias("is_hesitation"))


@query("prj6_sentence_end_flag", sql(f"SELECT recording_id, word_idx, {ends('word')} AS ends FROM words", "words"))
def _(spark, d):
    return fx.words(spark, d).select("recording_id", "word_idx", tokens.ends_sentence(C("word")).alias("ends"))


PAUSE_CLASS = """CASE WHEN is_last THEN 'none' WHEN pause_after_ms > 1000 THEN 'long' WHEN pause_after_ms > 500 THEN 'medium'
  WHEN pause_after_ms >= 200 AND NOT regexp_matches(word, '[.,!?;:]$') THEN 'comma' ELSE 'none' END"""
BAND = "CASE WHEN confidence < 0.85 THEN 'blurred' WHEN confidence < 0.95 THEN 'dim' ELSE 'clear' END"


@query("prj7_pause_class", sql(f"SELECT recording_id, word_idx, {PAUSE_CLASS} AS pause_class FROM phrased", "phrased"))
def _(spark, d):
    kind = timing.pause_class(C("word"), C("pause_after_ms"), C("is_last"))
    return fx.phrased(spark, d).select("recording_id", "word_idx", kind.alias("pause_class"))


@query("prj8_confidence_band", sql(f"SELECT recording_id, word_idx, {BAND} AS band FROM words", "words"))
def _(spark, d):
    return fx.words(spark, d).select("recording_id", "word_idx", timing.confidence_band(C("confidence")).alias("band"))


@query(
    "prj11_word_profile",
    sql(
        f"""SELECT recording_id, word_idx, word, end_ms - start_ms AS duration_ms, pause_after_ms, pause_after_ms > 500 AS long_pause,
        {PAUSE_CLASS} AS pause_class, stressed, confidence, {BAND} AS confidence_band FROM stressed""",
        "stressed",
    ),
)
def _(spark, d):
    return summary.word_profile(_featured(spark, d)).drop("pitch_change")


CONTOUR_RAW = f"""SELECT f.recording_id, f.frame_idx, s.f0 AS value FROM frames f LEFT JOIN ({pieces_of_runs()}) s
  USING (recording_id, frame_idx)"""
STATS = f"""SELECT w.recording_id, w.word_idx, any_value(w.word) AS word, any_value(w.start_ms) AS start_ms,
    any_value(w.end_ms) AS end_ms, count(c.value) AS n, avg(c.value) AS mean, max(c.value) AS top, min(c.value) AS bottom,
    arg_min(c.value, c.frame_idx) AS v0, arg_max(c.value, c.frame_idx) AS v1,
    list(c.value ORDER BY c.frame_idx) FILTER (c.value IS NOT NULL) AS vals
  FROM frame_words w LEFT JOIN ({CONTOUR_RAW}) c ON c.recording_id = w.recording_id
    AND c.frame_idx * 10 BETWEEN w.start_ms AND w.end_ms GROUP BY w.recording_id, w.word_idx"""
BOUNDS = f"""SELECT recording_id, coalesce(min(value), 0.0) AS low, coalesce(max(value), 1.0) AS high FROM ({CONTOUR_RAW})
  GROUP BY 1"""
TREND = """CASE WHEN mean IS NULL THEN NULL WHEN mean <= 0 OR abs(v1 - v0) < mean * 0.03::DOUBLE THEN '→'
  WHEN v1 - v0 > 0 THEN '↑' ELSE '↓' END"""
LEVEL = "CASE WHEN mean IS NULL THEN NULL WHEN high > low THEN (mean - low) / (high - low) ELSE 0.5 END"
CHARS = f"""CASE WHEN length(rtrim(trim(word), '{ot.MARKS}')) > 0 THEN length(rtrim(trim(word), '{ot.MARKS}'))
  ELSE greatest(1, length(word)) END"""


@query("prj12_pitch_trend", sql(f"SELECT recording_id, word_idx, {TREND} AS pitch_trend FROM ({STATS})", "frames", "runs", "frame_words"))
def _(spark, d):
    return _pitch(spark, d).select("recording_id", "word_idx", "pitch_trend")


INTON = """SELECT w.recording_id, w.word_idx, count(f.f0) AS n, avg(f.f0) AS mean, max(f.f0) - min(f.f0) AS spread,
    arg_min(f.f0, f.frame_idx) FILTER (f.f0 IS NOT NULL) AS v0, arg_max(f.f0, f.frame_idx) FILTER (f.f0 IS NOT NULL) AS v1
  FROM frame_words w LEFT JOIN frames f ON f.recording_id = w.recording_id AND f.frame_idx * 32 BETWEEN w.start_ms AND w.end_ms
  GROUP BY 1, 2"""
DIRECTION = "CASE WHEN n < 2 THEN 'unvoiced' WHEN v1 - v0 > 15 THEN 'rising' WHEN v1 - v0 < -15 THEN 'falling' ELSE 'flat' END"


@query("prj13_pitch_direction", sql(f"SELECT recording_id, word_idx, {DIRECTION} AS pitch_direction FROM ({INTON})", "frames", "frame_words"))
def _(spark, d):
    return _intonation(spark, d).select("recording_id", "word_idx", "pitch_direction")


@query(
    "prj14_normalize_pitch",
    sql(
        f"""SELECT recording_id, word_idx, round({LEVEL}, 6) AS normalized_pitch FROM ({STATS}) s JOIN ({BOUNDS}) b
        USING (recording_id)""",
        "frames", "runs", "frame_words",
    ),
)
def _(spark, d):
    return _pitch(spark, d).select("recording_id", "word_idx", r6("normalized_pitch"))


@query(
    "prj15_peak_gain",
    sql(
        """SELECT recording_id, block_idx, round(sum(abs(x)) * any_value(g), 6) AS energy, round(any_value(g), 6) AS gain
        FROM samples JOIN (SELECT recording_id, CASE WHEN max(abs(x)) > 1e-4 AND max(abs(x)) < 0.5 THEN 0.85 / max(abs(x)) ELSE 1 END AS g
          FROM samples GROUP BY 1) USING (recording_id) GROUP BY 1, 2""",
        "samples",
    ),
)
def _(spark, d):
    scaled = audio.peak_gain(fx.pcm_blocks(spark, d))
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + F.abs(x))
    return scaled.select("recording_id", "block_idx", r6_expr(total, "energy"), r6("gain"))


@query(
    "prj16_frame_time",
    sql("SELECT recording_id, frame_idx, frame_idx * 10 AS time_ms FROM frames UNION ALL"
        " SELECT recording_id, frame_idx, frame_idx * 32 FROM frames", "frames"),
)
def _(spark, d):
    both = fx.pitch_frames(spark, d, "a").unionByName(fx.pitch_frames(spark, d, "b"))
    return both.select("recording_id", "frame_idx", timing.frame_time_ms(C("frame_idx"), C("hop_ms")).alias("time_ms"))


@query("prj17_voiced_flag", sql("SELECT recording_id, frame_idx, coalesce(f0 > 0, false) AS voiced FROM frames", "frames"))
def _(spark, d):
    return fx.pitch_frames(spark, d).select("recording_id", "frame_idx", pitch_fn.voiced(C("f0")).alias("voiced"))


@query(
    "prj19_char_count",
    sql(
        f"""SELECT recording_id, word_idx, {CHARS} AS n_chars,
        length(regexp_replace(word, '[.,!?;:"''\\-]+$', '')) AS n_shown FROM words""",
        "words",
    ),
)
def _(spark, d):
    return fx.words(spark, d).select(
        "recording_id", "word_idx", tokens.char_count(C("word")).cast("bigint").alias("n_chars"),
        tokens.display_char_count(C("word")).cast("bigint").alias("n_shown"),
    )


@query(
    "prj20_sentence_case",
    sql(
        f"""SELECT recording_id, word_idx, CASE WHEN is_last AND w2 <> '' AND NOT {ends('w2')} THEN
          CASE WHEN right(w2, 1) IN (',', ';', ':') THEN rtrim(w2, ',;:') || '.' ELSE w2 || '.' END ELSE w2 END AS word
        FROM (SELECT *, CASE WHEN pos = 0 AND {lower_head('word')} THEN upper(left(word, 1)) || substr(word, 2) ELSE word END AS w2
          FROM phrased)""",
        "phrased",
    ),
)
def _(spark, d):
    cased = tokens.sentence_case(C("word"), C("pos") == 0, C("is_last"))
    return fx.phrased(spark, d).select("recording_id", "word_idx", cased.alias("word"))


# ---- joins -------------------------------------------------------------------------------------------------------


def _featured(spark, d, written=False):
    labels = stress.normalize_labels(fx.stress_labels(spark, d))
    words = fx.phrased(spark, d)
    return stress.align_stress(words.drop("word_idx", "is_last") if written else words, labels, written=written)


@query("jn1_stress_align", sql("SELECT recording_id, word_idx, stressed, stress_score FROM stressed", "stressed"))
def _(spark, d):
    return _featured(spark, d).select("recording_id", "word_idx", "stressed", "stress_score")


@query(
    "jn2_positional_join",
    sql(
        f"""SELECT p.recording_id, p.word_idx, p.pos, s.stressed, {hesitates('p.word', 'p.end_ms - p.start_ms')} AS is_hesitation,
        p.pause_after_ms FROM phrased p JOIN stressed s USING (recording_id, word_idx)""",
        "phrased", "stressed",
    ),
)
def _(spark, d):
    tables = {"stress_labels": fx.stress_labels(spark, d)}
    return sessions.analyze(fx.words(spark, d).drop("turn"), tables).select(
        "recording_id", "word_idx", "pos", "stressed", "is_hesitation", "pause_after_ms"
    )


@query(
    "jn3_words_x_frames",
    sql(
        """SELECT w.recording_id, w.word_idx, f.frame_idx, round(f.f0, 6) AS f0 FROM frame_words w LEFT JOIN frames f
        ON f.recording_id = w.recording_id AND f.frame_idx * 10 BETWEEN w.start_ms AND w.end_ms""",
        "frames", "frame_words",
    ),
)
def _(spark, d):
    frames = fx.pitch_frames(spark, d).select("recording_id", "frame_idx", "f0")
    return word_pitch.words_x_frames(fx.frame_words(spark, d), frames).select(
        "recording_id", "word_idx", "frame_idx", r6("f0")
    )


SEGMENT_ROWS = f"""SELECT recording_id, start_frame, max(frame_idx) AS end_frame, list(f0 ORDER BY frame_idx) AS x,
  row_number() OVER (PARTITION BY recording_id ORDER BY start_frame) - 1 AS segment_index FROM ({pieces_of_runs()})
  GROUP BY recording_id, start_frame"""


@query(
    "jn4_word_in_segment",
    sql(
        f"""SELECT w.recording_id, w.word_idx, min(s.segment_index) AS voiced_segment_index FROM frame_words w LEFT JOIN ({SEGMENT_ROWS}) s
        ON s.recording_id = w.recording_id AND (w.start_ms + w.end_ms) / 2 BETWEEN s.start_frame * 10 AND s.end_frame * 10
        GROUP BY 1, 2""",
        "frames", "runs", "frame_words",
    ),
)
def _(spark, d):
    segments = voicing.voiced_segments(fx.pitch_frames(spark, d)).drop("x")
    return word_pitch.word_in_segment(fx.frame_words(spark, d), segments).select(
        "recording_id", "word_idx", "voiced_segment_index"
    )


@query(
    "jn5_slice_audio_by_phrase",
    sql(
        """SELECT p.recording_id, p.phrase_index, s.block_idx, count(*) AS n_samples, round(sum(s.x), 6) AS total
        FROM (SELECT recording_id, phrase_index, min(start_ms) * 64 // 1000 AS a, arg_max(end_ms, pos) * 64 // 1000 AS b
          FROM phrased GROUP BY 1, 2) p
        JOIN samples s ON s.recording_id = p.recording_id AND s.n_at >= p.a AND s.n_at < p.b GROUP BY 1, 2, 3""",
        "phrased", "samples",
    ),
)
def _(spark, d):
    bounds = phrases.phrase_bounds(fx.phrased(spark, d))
    pieces = audio.slice_by_phrase(bounds, fx.pcm_blocks(spark, d), rate=64, block_samples=64)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return pieces.select("recording_id", "phrase_index", "block_idx", F.size("samples").cast("bigint").alias("n_samples"),
                         r6_expr(total, "total"))


@query(
    "jn6_lookup_word_class",
    sql(
        f"""SELECT recording_id, word_idx, {clean('word')} IN ({ot.NON_ENDER_LIST}) AS non_ender, v.token IS NOT NULL AS lowercaseable
        FROM words LEFT JOIN vocabulary v ON v.token = {clean('word')}""",
        "words", "vocabulary",
    ),
)
def _(spark, d):
    classed = phrases.classify_tokens(fx.words(spark, d), fx.casing_vocabulary(spark, d))
    return classed.select("recording_id", "word_idx", "non_ender", "lowercaseable")


@query(
    "jn7_orphan_sessions",
    sql("SELECT recording_id, count(*) AS n_chunks FROM chunk_texts WHERE recording_id % 4 = 0 GROUP BY 1", "chunk_texts"),
)
def _(spark, d):
    return jobs.orphan_sessions(fx.audio_chunks(spark, d))


# ---- aggregations ------------------------------------------------------------------------------------------------

SUMMARY = """SELECT r.recording_id, r.duration_ms / 1000.0 AS total_duration, count(s.word_idx) AS word_count,
  round(count(s.word_idx) / (r.duration_ms / 60000.0), 6) AS wpm,
  round(coalesce(avg(CASE WHEN s.stressed THEN 1 ELSE 0 END), 0), 6) AS stress_ratio, 0.0 AS pitch_variation
  FROM recordings r LEFT JOIN stressed s USING (recording_id) GROUP BY 1, r.duration_ms"""


@query("agg1_session_summary", sql(SUMMARY, "recordings", "stressed"))
def _(spark, d):
    rows = summary.session_summary(_featured(spark, d), fx.recordings(spark, d))
    return rows.withColumns({"wpm": F.round("wpm", 6), "stress_ratio": F.round("stress_ratio", 6)})


@query(
    "agg1_session_summary_pitch",
    sql(
        f"""SELECT recording_id, count(*) AS word_count, CASE WHEN count(m) >= 2 THEN round(stddev_pop(m), 1) ELSE 0.0 END
        AS pitch_variation FROM (SELECT recording_id, CASE WHEN n >= 2 THEN mean END AS m FROM ({INTON})) GROUP BY 1""",
        "frames", "frame_words",
    ),
)
def _(spark, d):
    words = _intonation(spark, d).withColumn("stressed", F.lit(False))
    length = fx.pitch_frames(spark, d).groupBy("recording_id").agg((F.max("frame_idx") * 10 + 10).alias("duration_ms"))
    return summary.session_summary(words, length).select("recording_id", "word_count", "pitch_variation")


@query(
    "agg2_avg_confidence_pct",
    sql("SELECT recording_id, CAST(round(avg(confidence) * 100) AS BIGINT) AS avg_confidence_pct FROM absorbed GROUP BY 1", "absorbed"),
)
def _(spark, d):
    return pauses.average_confidence(pauses.absorb_hesitations(fx.phrased(spark, d)))


@query(
    "agg3_phrase_build",
    sql(
        """SELECT recording_id, phrase_index, pos, word, min(start_ms) OVER p AS start_ms, arg_max(end_ms, pos) OVER p AS end_ms,
        count(*) OVER p AS n_words FROM phrased WINDOW p AS (PARTITION BY recording_id, phrase_index)""",
        "phrased",
    ),
)
def _(spark, d):
    nested = phrases.build_phrases(fx.phrased(spark, d)).withColumnsRenamed({"start_ms": "a", "end_ms": "b"})
    words = nested.select("recording_id", "phrase_index", "a", "b", "n_words", "first_pos", F.posexplode(F.split("text", " ")).alias("p", "word"))
    return words.select(
        "recording_id", "phrase_index", (C("first_pos") + C("p")).alias("pos"), "word", C("a").alias("start_ms"), C("b").alias("end_ms"), "n_words"
    )


@query(
    "agg3_chunk_phrases",
    chunk_sql(
        """SELECT c.recording_id, c.chunk_index AS phrase_index, coalesce(string_agg(w.word, ' ' ORDER BY w.word_idx), '') AS text,
        coalesce(min(w.start_ms) FILTER (c.chunk_index % 10 <> 9), any_value(c.start_sample // 16)) AS start_ms,
        coalesce(arg_max(w.end_ms, w.word_idx) FILTER (c.chunk_index % 10 <> 9), any_value(c.start_sample // 16)) AS end_ms,
        count(w.word_idx) FILTER (c.chunk_index % 10 <> 9) AS n_words
        FROM chunk_rows c LEFT JOIN (SELECT w.*, c.chunk_index, w.start_ms * 16 <= c.end_sample AS inside FROM words w ASOF JOIN chunk_rows c
          ON w.recording_id = c.recording_id AND w.start_ms * 16 >= c.start_sample) w
          ON w.recording_id = c.recording_id AND w.chunk_index = c.chunk_index AND w.inside GROUP BY 1, 2"""
    ),
)
def _(spark, d):
    rows = cut(_chunk_words(spark, d), "chunk-words")
    piece = F.struct("word_idx", "word")
    texts = rows.groupBy("recording_id", "chunk_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda w: w["word"]), " ").alias("text")
    )
    # The recogniser gives text without word times for every tenth chunk.
    timed = rows.filter(C("chunk_index") % 10 != 9).withColumn("pos", C("word_idx"))
    merged = phrases.chunk_phrases(timed, _chunks(spark, d), texts)
    return merged.drop("words").withColumn("n_words", C("n_words").cast("bigint"))


def _pitch(spark, d, criterion="none"):
    return sessions.pitch_features(fx.frame_words(spark, d), fx.pitch_frames(spark, d), criterion)


def _intonation(spark, d):
    words = fx.frame_phrased(spark, d)
    return word_pitch.word_intonation(words, fx.pitch_frames(spark, d, "b").select("recording_id", "frame_idx", "f0"))


@query(
    "agg4_word_pitch_features",
    sql(
        f"""SELECT recording_id, word_idx, round(mean, 6) AS mean_pitch, round(top, 6) AS max_pitch, round(bottom, 6) AS min_pitch,
        round(v0, 6) AS start_pitch, round(v1, 6) AS end_pitch, round(v1 - v0, 6) AS pitch_slope, round(top - bottom, 6) AS pitch_range
        FROM ({STATS})""",
        "frames", "runs", "frame_words",
    ),
)
def _(spark, d):
    names = ["mean_pitch", "max_pitch", "min_pitch", "start_pitch", "end_pitch", "pitch_slope", "pitch_range"]
    return _pitch(spark, d).select("recording_id", "word_idx", *[r6(n) for n in names])


@query("agg4_word_pitch_features_mae")
def _(spark, d):
    return _pitch(spark, d, "mae").select("recording_id", "word_idx", "pitch_trend", r6("mean_pitch"), "voiced_segment_index")


@query(
    "agg5_word_intonation",
    sql(
        f"""SELECT recording_id, word_idx, CASE WHEN n >= 2 THEN round(mean, 6) END AS pitch_mean, CASE WHEN n >= 2 THEN round(v0, 6) END
        AS pitch_start, CASE WHEN n >= 2 THEN round(v1, 6) END AS pitch_end, {DIRECTION} AS pitch_direction,
        CASE WHEN n >= 2 THEN round(spread, 6) ELSE 0.0 END AS inton_pitch_range FROM ({INTON})""",
        "frames", "frame_words",
    ),
)
def _(spark, d):
    return _intonation(spark, d).select(
        "recording_id", "word_idx", r6("pitch_mean"), r6("pitch_start"), r6("pitch_end"), "pitch_direction",
        r6("inton_pitch_range"),
    )


@query(
    "agg6_contour_range",
    sql(f"SELECT recording_id, round(low, 6) AS low, round(high, 6) AS high FROM ({BOUNDS})", "frames", "runs"),
)
def _(spark, d):
    return stylize.contour_range(_contour(spark, d)).select("recording_id", r6("low"), r6("high"))


def _contour(spark, d, criterion="none"):
    frames = fx.pitch_frames(spark, d)
    return stylize.full_contour(frames, _styled(spark, d, criterion))


def _styled(spark, d, criterion):
    return stylize.stylize_segments(stylize.with_piece_count(voicing.voiced_segments(fx.pitch_frames(spark, d))), criterion)


@query(
    "agg7_voicing_rate",
    sql(
        f"""SELECT r.recording_id, n_frames, n_voiced, round(n_voiced / n_frames, 6) AS voiced_share, coalesce(n_segments, 0) AS n_segments,
        min_segment, max_segment, round(avg_segment, 6) AS avg_segment
        FROM (SELECT recording_id, count(*) AS n_frames, count(*) FILTER (run_len >= 3) AS n_voiced FROM runs GROUP BY 1) r
        LEFT JOIN (SELECT recording_id, count(*) AS n_segments, min(segment_len) AS min_segment, max(segment_len) AS max_segment,
          avg(segment_len) AS avg_segment FROM ({pieces_of_runs(24)}) WHERE frame_idx = start_frame GROUP BY 1) s USING (recording_id)""",
        "runs",
    ),
)
def _(spark, d):
    return voicing.voicing_rate(fx.pitch_frames(spark, d), max_len=24).withColumns(
        {"voiced_share": F.round("voiced_share", 6), "avg_segment": F.round("avg_segment", 6)}
    )


@query(
    "agg8_rms_per_second",
    sql("SELECT recording_id, n_at // 48 AS second, round(sqrt(avg(x * x)), 6) AS rms FROM samples GROUP BY 1, 2", "samples"),
)
def _(spark, d):
    return audio.rms_per_second(fx.pcm_blocks(spark, d), rate=48).select("recording_id", "second", r6("rms"))


@query("agg9_job_state", sql("SELECT * FROM job_state", "job_state"))
def _(spark, d):
    return jobs.job_state(fx.job_events(spark, d))


@query("agg10_peak_abs", sql("SELECT recording_id, round(max(abs(x)), 6) AS peak FROM samples GROUP BY 1", "samples"))
def _(spark, d):
    return audio.peak_abs(fx.pcm_blocks(spark, d)).select("recording_id", r6("peak"))


@query("agg11_stylization_rmse")
def _(spark, d):
    return stylize.rmse_report(_styled(spark, d, "mse"), _styled(spark, d, "mae")).select(
        "n_segments", r6("mse_rmse"), r6("mae_rmse"), r6("improvement")
    )


LINES = f"""SELECT recording_id, start_frame, count(*) AS n, regr_slope(f0, frame_idx - start_frame + 1) AS slope,
  regr_intercept(f0, frame_idx - start_frame + 1) AS intercept FROM ({pieces_of_runs()}) GROUP BY 1, 2"""


@query(
    "agg11_line_rmse",
    sql(
        f"""SELECT recording_id, start_frame, round(sqrt(avg(pow(f0 - (intercept + slope * (frame_idx - start_frame + 1)), 2))), 5)
        AS rmse FROM ({pieces_of_runs()}) JOIN ({LINES}) USING (recording_id, start_frame) GROUP BY 1, 2""",
        "runs",
    ),
)
def _(spark, d):
    rows = stylize.line_contour(voicing.segment_frames(fx.pitch_frames(spark, d)))
    return rows.groupBy("recording_id", "start_frame").agg(
        F.round(F.sqrt(F.avg(F.pow(C("f0") - C("line"), 2))), 5).alias("rmse")
    )


@query(
    "agg12_octave_histogram",
    sql(
        f"""SELECT * FROM (WITH points AS (SELECT log2(f0 / line) AS lr FROM (SELECT f0, intercept + slope * (frame_idx - start_frame + 1) AS line
            FROM ({pieces_of_runs()}) JOIN ({LINES}) USING (recording_id, start_frame)) WHERE f0 > 0 AND line > 0),
          span AS (SELECT min(lr) AS low, (max(lr) - min(lr)) / 40 AS width, count(*) AS total FROM points),
          counted AS (SELECT CAST(least(floor((lr - low) / width), 39) AS INTEGER) AS bin, count(*) AS n FROM points, span GROUP BY 1)
        SELECT g.bin::INTEGER AS bin, coalesce(n, 0) AS n, round(low + g.bin * width, 5) AS left_edge,
        round(coalesce(n, 0) / (total * width), 5) AS density,
        CASE WHEN abs(low + (g.bin + 0.5) * width - 1) <= 0.1 THEN 'doubling'
          WHEN abs(low + (g.bin + 0.5) * width + 1) <= 0.1 THEN 'halving' END AS octave
        FROM span CROSS JOIN range(40) AS g(bin) LEFT JOIN counted USING (bin))""",
        "runs",
    ),
)
def _(spark, d):
    rows = stylize.line_contour(voicing.segment_frames(fx.pitch_frames(spark, d)))
    points = rows.select(C("f0").alias("estimate"), C("line").alias("reference"))
    return stylize.octave_histogram(points).withColumns(
        {"left_edge": F.round("left_edge", 5), "density": F.round("density", 5)}
    )


QUALITY = """SELECT recording_id, count(*) AS n_chunks, min(e - s) AS min_ms, max(e - s) AS max_ms, CAST(sum(e - s) AS BIGINT) AS covered_ms,
  round(avg(e - s), 6) AS avg_ms, round(sum(e - s) / any_value(duration_ms), 6) AS coverage
  FROM (SELECT recording_id, start_sample // 16 AS s, end_sample // 16 AS e FROM chunk_rows) JOIN recordings USING (recording_id)
  GROUP BY 1"""


def _chunks(spark, d, max_ms=chunks.MAX_MS, target_ms=chunks.TARGET_MS):
    recs = fx.recordings(spark, d)
    full = chunks.with_fallback(fx.staged_segments(spark, d), recs)
    return chunks.merge_chunks(chunks.pad_and_split(full, recs, max_ms=max_ms), target_ms=target_ms)


@query("agg13_chunk_quality", chunk_sql(QUALITY))
def _(spark, d):
    return chunks.chunk_quality(_chunks(spark, d), fx.recordings(spark, d).drop("sample_rate")).withColumns(
        {"avg_ms": F.round("avg_ms", 6), "coverage": F.round("coverage", 6)}
    )


@query(
    "agg14_asr_quality",
    sql(
        """SELECT r.recording_id, count(w.word_idx) AS n_words, round(avg(w.confidence), 6) AS avg_confidence, r.duration_ms,
        epoch_ms(any_value(j.completed_at)) - epoch_ms(any_value(j.started_at)) AS processing_ms,
        round((epoch_ms(any_value(j.completed_at)) - epoch_ms(any_value(j.started_at))) / r.duration_ms, 6) AS rtf
        FROM recordings r LEFT JOIN words w USING (recording_id) LEFT JOIN job_state j ON j.job_id = r.recording_id
        GROUP BY r.recording_id, r.duration_ms""",
        "words", "recordings", "job_state",
    ),
)
def _(spark, d):
    rows = jobs.asr_quality(fx.words(spark, d), fx.recordings(spark, d), jobs.job_state(fx.job_events(spark, d)))
    return rows.withColumns({"avg_confidence": F.round("avg_confidence", 6), "rtf": F.round("rtf", 6)})


@query(
    "agg14_asr_quality_totals",
    sql(
        """SELECT count(*) AS n_recordings, sum(n_words)::BIGINT AS n_words, round(sum(confidence) / sum(n_words), 6) AS avg_confidence,
        sum(duration_ms)::BIGINT AS duration_ms, sum(processing_ms)::BIGINT AS processing_ms, round(sum(processing_ms) / sum(duration_ms), 6) AS rtf
        FROM (SELECT r.recording_id, any_value(r.duration_ms) AS duration_ms, count(w.word_idx) AS n_words,
          sum(CASE WHEN w.word_idx IS NOT NULL THEN coalesce(w.confidence, 1.0) END) AS confidence,
          epoch_ms(any_value(j.completed_at)) - epoch_ms(any_value(j.started_at)) AS processing_ms
          FROM recordings r LEFT JOIN words w USING (recording_id) LEFT JOIN job_state j ON j.job_id = r.recording_id GROUP BY 1)""",
        "words", "recordings", "job_state",
    ),
)
def _(spark, d):
    rows = jobs.asr_quality(fx.words(spark, d), fx.recordings(spark, d), jobs.job_state(fx.job_events(spark, d)))
    return jobs.asr_quality_totals(rows).withColumns({"avg_confidence": F.round("avg_confidence", 6), "rtf": F.round("rtf", 6)})


@query(
    "agg15_mse_fit_k1",
    sql(f"SELECT recording_id, start_frame, n, round(slope, 5) AS slope, round(intercept, 5) AS intercept FROM ({LINES})", "runs"),
)
def _(spark, d):
    rows = stylize.line_per_segment(voicing.segment_frames(fx.pitch_frames(spark, d)))
    return rows.select("recording_id", "start_frame", "n", F.round("slope", 5).alias("slope"),
                       F.round("intercept", 5).alias("intercept"))


# ---- windows -----------------------------------------------------------------------------------------------------


@query("win1_pause_after", sql("SELECT recording_id, word_idx, pause_after_ms FROM phrased", "phrased"))
def _(spark, d):
    return phrases.phrase_words(fx.words(spark, d).drop("turn")).select("recording_id", "word_idx", "pause_after_ms")


@query("win2_group_by_punctuation", sql("SELECT recording_id, word_idx, phrase_index, pos FROM phrased", "phrased"))
def _(spark, d):
    return phrases.group_by_punctuation(fx.words(spark, d)).select("recording_id", "word_idx", "phrase_index", "pos")


@query("win3_false_period_cleanup", sql("SELECT recording_id, word_idx, word, false_period FROM repaired", "repaired"))
def _(spark, d):
    fixed = phrases.repair_false_periods(fx.words(spark, d), fx.casing_vocabulary(spark, d))
    return fixed.select("recording_id", "word_idx", "word", "false_period")


@query(
    "win4_reconstruct_sentences",
    sql("SELECT recording_id, word_idx, word, phrase_index, pos, is_last FROM sentences", "sentences"),
)
def _(spark, d):
    rows = phrases.reconstruct_sentences(fx.words(spark, d).drop("turn"), fx.casing_vocabulary(spark, d))
    return rows.select("recording_id", "word_idx", "word", "phrase_index", "pos", "is_last")


@query(
    "win5_absorb_hesitations",
    sql("SELECT recording_id, word_idx, phrase_index, pos, word, pause_after_ms, absorbed FROM absorbed", "absorbed"),
)
def _(spark, d):
    return pauses.absorb_hesitations(fx.phrased(spark, d)).select(
        "recording_id", "word_idx", "phrase_index", "pos", "word", "pause_after_ms", "absorbed"
    )


@query(
    "win6_clean_short_voiced_runs",
    sql("SELECT recording_id, frame_idx, round(CASE WHEN run_len >= 3 THEN f0 END, 6) AS f0 FROM runs", "runs"),
)
def _(spark, d):
    return voicing.clean_short_runs(fx.pitch_frames(spark, d)).select("recording_id", "frame_idx", r6("f0"))


def _segment_sql(max_len):
    return sql(
        f"""SELECT recording_id, start_frame, max(frame_idx) AS end_frame, count(*) AS n, round(sum(f0), 6) AS total,
        row_number() OVER (PARTITION BY recording_id ORDER BY start_frame) - 1 AS segment_index
        FROM ({pieces_of_runs(max_len)}) GROUP BY recording_id, start_frame""",
        "runs",
    )


def _segment_rows(spark, d, max_len):
    rows = voicing.voiced_segments(fx.pitch_frames(spark, d), max_len=max_len)
    return rows.select(
        "recording_id", "start_frame", "end_frame", F.size("x").cast("bigint").alias("n"),
        r6_expr(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), "total"), "segment_index",
    )


@query("win7_voiced_segments", _segment_sql(500))
def _(spark, d):
    return _segment_rows(spark, d, 500)


@query("win7_voiced_segments_split", _segment_sql(24))
def _(spark, d):
    return _segment_rows(spark, d, 24)


PIECES = "SELECT recording_id, seg_idx, part, start_sample, end_sample FROM ({})"


@query("win8_pad_and_split", sql(PIECES.format(ot.split_segments(29_000)), "segments_full", "recordings"))
def _(spark, d):
    recs = fx.recordings(spark, d)
    return chunks.pad_and_split(chunks.with_fallback(fx.staged_segments(spark, d), recs), recs)


@query("win8_pad_and_split_short", sql(PIECES.format(ot.split_segments(8_000)), "segments_full", "recordings"))
def _(spark, d):
    recs = fx.recordings(spark, d)
    return chunks.pad_and_split(chunks.with_fallback(fx.staged_segments(spark, d), recs), recs, max_ms=8_000)


MERGED = """SELECT recording_id, chunk_index, start_sample, end_sample, n_segments, start_sample // 16 AS start_ms,
  end_sample // 16 AS end_ms FROM chunk_rows"""


@query("win9_merge_speech_chunks", chunk_sql(MERGED))
def _(spark, d):
    return _chunks(spark, d)


@query("win9_merge_speech_chunks_short", chunk_sql(MERGED, 8_000, 6_000))
def _(spark, d):
    return _chunks(spark, d, 8_000, 6_000)


@query("win10_no_speech_fallback", sql("SELECT * FROM segments_full", "segments_full"))
def _(spark, d):
    return chunks.with_fallback(fx.staged_segments(spark, d), fx.recordings(spark, d))


@query(
    "win11_sentence_intonation",
    sql(
        f"""SELECT recording_id, phrase_index, CASE WHEN len(dirs) = 0 THEN 'flat' WHEN len(dirs) >= 2 AND dirs[len(dirs) - 1] = 'rising'
          AND dirs[len(dirs)] = 'falling' THEN 'rise-fall' ELSE dirs[len(dirs)] END AS intonation_pattern
        FROM (SELECT recording_id, phrase_index, coalesce(list(dir ORDER BY word_idx) FILTER (dir <> 'unvoiced'), []) AS dirs
          FROM (SELECT w.*, {DIRECTION} AS dir FROM (SELECT *, CAST(word_idx // 4 AS BIGINT) AS phrase_index FROM frame_words) w
            JOIN ({INTON}) USING (recording_id, word_idx)) GROUP BY 1, 2)""",
        "frames", "frame_words",
    ),
)
def _(spark, d):
    return word_pitch.sentence_intonation(_intonation(spark, d))


@query(
    "win12_running_partial_results",
    sql(
        """SELECT recording_id, phrase_index, CAST(word_count AS BIGINT) AS word_count, round(word_count / (duration_ms / 60000.0), 6) AS wpm,
        round(sc / word_count, 6) AS stress_ratio, round(0.2 + 0.55 * (phrase_index + 1) / np, 6) AS progress,
        phrase_index + 1 AS completed_chunks,
        'analyzing_sentence_' || (phrase_index + 1) || '_of_' || np AS current_stage
        FROM (SELECT *, sum(n) OVER w AS word_count, sum(s) OVER w AS sc, count(*) OVER (PARTITION BY recording_id) AS np
          FROM (SELECT recording_id, phrase_index, count(*) AS n, sum(CASE WHEN stressed THEN 1 ELSE 0 END) AS s FROM stressed GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY recording_id ORDER BY phrase_index)) JOIN recordings USING (recording_id)""",
        "stressed", "recordings",
    ),
)
def _(spark, d):
    rows = summary.partial_results(_featured(spark, d), fx.recordings(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("wpm", "stress_ratio", "progress")})


@query(
    "win13_duplicate_adjacent_chunk",
    sql(
        """SELECT recording_id, seq, strlen(content) AS n_bytes, coalesce(content = lag(content)
        OVER (PARTITION BY recording_id ORDER BY seq), false) AS same_as_previous FROM chunk_texts""",
        "chunk_texts",
    ),
)
def _(spark, d):
    return audio.repeated_chunks(fx.audio_chunks(spark, d)).withColumn("n_bytes", C("n_bytes").cast("bigint"))


@query(
    "win13_duplicate_adjacent_span",
    """SELECT page_id AS file_id, i - 2 AS span_idx, coalesce(piece = lag(piece) OVER (PARTITION BY page_id ORDER BY i), false)
      AS same_as_previous FROM (SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
        FROM (SELECT page_id, string_split(regexp_replace(html, '[^\\x{00}-\\x{ff}]', '?', 'g'), '<p>') AS p FROM pages)) WHERE i > 1""",
)
def _(spark, d):
    spans = recordings.marker_spans(_containers(spark, d), "file_id")
    return recordings.repeated_spans(spans.drop("position", "n_bytes"), "file_id")


CHECKS = """SELECT recording_id, bool_and(coalesce(s < ns, true)) AS ordered, bool_and(coalesce(e <= ns + 10, true)) AS disjoint,
  bool_and(e > s) AS non_empty, bool_and(e - s <= {bound}) AS bounded
  FROM (SELECT *, lead(s) OVER (PARTITION BY recording_id ORDER BY chunk_index) AS ns FROM (SELECT recording_id, chunk_index,
    start_sample // 16 AS s, end_sample // 16 AS e FROM chunk_rows)) GROUP BY 1"""


@query("win14_chunk_order_checks", chunk_sql(CHECKS.format(bound=29_000)))
def _(spark, d):
    return chunks.order_checks(_chunks(spark, d))


# ---- sorts and sets ----------------------------------------------------------------------------------------------


@query(
    "srt1_next_queued_job",
    sql("SELECT job_id, status, created_at FROM job_state WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 1", "job_state"),
)
def _(spark, d):
    return jobs.next_queued(jobs.job_state(fx.job_events(spark, d))).select("job_id", "status", "created_at")


@query(
    "srt2_flatten_words_in_order",
    sql("SELECT recording_id, phrase_index, pos, word_idx AS global_idx, word FROM phrased", "phrased"),
)
def _(spark, d):
    rows = fx.phrased(spark, d).select("recording_id", "phrase_index", "pos", "word")
    return summary.number_words(rows)


@query(
    "set1_union_phrase_words",
    sql("SELECT recording_id, phrase_index, word, start_ms, end_ms FROM phrased", "phrased"),
)
def _(spark, d):
    nested = phrases.build_phrases(fx.phrased(spark, d))
    return nested.select("recording_id", "phrase_index", F.inline("words")).select(
        "recording_id", "phrase_index", "word", "start_ms", "end_ms"
    )


@query(
    "set2_finalized_sessions",
    sql("SELECT recording_id, count(*) AS n_chunks, recording_id % 4 <> 0 AS stopped FROM chunk_texts GROUP BY 1", "chunk_texts"),
)
def _(spark, d):
    return jobs.finished_sessions(fx.audio_chunks(spark, d))


# ---- contours ----------------------------------------------------------------------------------------------------


@query(
    "arr1_fill_gaps_linear",
    sql(
        """SELECT recording_id, frame_idx, round(CASE WHEN f0 IS NOT NULL THEN f0 WHEN b IS NULL THEN fa WHEN a IS NULL THEN fb
          ELSE fb + (fa - fb) * ((frame_idx - b) / (a - b)) END, 6) AS f0_filled
        FROM (SELECT f.*, x.frame_idx AS b, x.f0 AS fb, y.frame_idx AS a, y.f0 AS fa FROM frames f
          ASOF LEFT JOIN (SELECT * FROM frames WHERE f0 IS NOT NULL) x ON x.recording_id = f.recording_id AND f.frame_idx >= x.frame_idx
          ASOF LEFT JOIN (SELECT * FROM frames WHERE f0 IS NOT NULL) y ON y.recording_id = f.recording_id AND f.frame_idx <= y.frame_idx)""",
        "frames",
    ),
)
def _(spark, d):
    return voicing.fill_gaps(fx.pitch_frames(spark, d)).select("recording_id", "frame_idx", r6("f0_filled"))


@query(
    "arr2_resample_linear",
    sql(
        f"""SELECT recording_id, segment_index, i, round(x[lo + 1] + (x[hi + 1] - x[lo + 1]) * (q - lo), 6) AS value
        FROM (SELECT *, CAST(floor(q) AS BIGINT) AS lo, CAST(ceil(q) AS BIGINT) AS hi FROM (SELECT *, i * (len(x) - 1) / 6 AS q
          FROM (SELECT *, unnest(range(0, 7)) AS i FROM ({SEGMENT_ROWS}))))""",
        "runs",
    ),
)
def _(spark, d):
    rows = voicing.voiced_segments(fx.pitch_frames(spark, d)).withColumn("n", F.lit(7))
    return rows.select(
        "recording_id", "segment_index", F.posexplode(contour_fn.resample_linear("x", "n")).alias("i", "value")
    ).withColumn("value", F.round("value", 6))


@query(
    "arr2_display_resample",
    sql(
        f"""SELECT recording_id, segment_index, round(x[lo + 1] * (1 - (q - lo)) + x[hi + 1] * (q - lo), 6) AS middle
        FROM (SELECT *, CAST(floor(q) AS BIGINT) AS lo, CAST(ceil(q) AS BIGINT) AS hi
          FROM (SELECT *, (len(x) - 1) / 2 AS q FROM ({SEGMENT_ROWS})))""",
        "runs",
    ),
)
def _(spark, d):
    rows = voicing.voiced_segments(fx.pitch_frames(spark, d)).withColumn("n", F.lit(1))
    return rows.select(
        "recording_id", "segment_index", r6_expr(contour_fn.display_resample("x", "n")[0], "middle")
    )


@query(
    "arr3_char_pitches",
    sql(
        f"""SELECT recording_id, word_idx, i, round(CASE WHEN n < 2 OR nc <= 1 THEN {LEVEL} WHEN high > low THEN
          (vals[lo + 1] + (vals[hi + 1] - vals[lo + 1]) * (q - lo) - low) / (high - low) ELSE 0.5 END, 6) AS value
        FROM (SELECT *, CAST(floor(q) AS BIGINT) AS lo, CAST(ceil(q) AS BIGINT) AS hi
          FROM (SELECT *, i * (n - 1) / greatest(nc - 1, 1) AS q FROM (SELECT *, unnest(range(0, nc)) AS i
            FROM (SELECT s.*, b.low, b.high, {CHARS} AS nc FROM ({STATS}) s JOIN ({BOUNDS}) b USING (recording_id) WHERE n > 0))))""",
        "frames", "runs", "frame_words",
    ),
)
def _(spark, d):
    return _pitch(spark, d).select("recording_id", "word_idx", F.posexplode("char_pitches").alias("i", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query(
    "arr4_build_full_contour",
    sql(f"SELECT recording_id, frame_idx, round(value, 6) AS value FROM ({CONTOUR_RAW})", "frames", "runs"),
)
def _(spark, d):
    return _contour(spark, d).select("recording_id", "frame_idx", r6("value"))


def _haar(column: str) -> tuple[str, str]:
    both = "[{c}[2 * i + 1] {op} coalesce({c}[2 * i + 2], {c}[2 * i + 1]) FOR i IN range(0, (len({c}) + 1) // 2)]"
    return both.format(c=column, op="+"), both.format(c=column, op="-")


@query(
    "arr5_haar_k_estimate",
    sql(
        f"""SELECT recording_id, segment_index, CASE WHEN len(dt) < 3 THEN 1 ELSE least(8, 1 + len([i FOR i IN range(2, len(dt))
          IF (dt[i] > dt[i - 1] AND dt[i] > dt[i + 1]) OR (dt[i] < dt[i - 1] AND dt[i] < dt[i + 1])])) END AS k
        FROM (SELECT *, {_haar('a2')[1]} AS dt FROM (SELECT *, {_haar('a1')[0]} AS a2 FROM (SELECT *, {_haar('x')[0]} AS a1
          FROM ({SEGMENT_ROWS}))))""",
        "runs",
    ),
)
def _(spark, d):
    rows = stylize.with_piece_count(voicing.voiced_segments(fx.pitch_frames(spark, d)))
    return rows.select("recording_id", "segment_index", C("k").cast("bigint").alias("k"))


def _styled_rows(spark, d, criterion):
    return _styled(spark, d, criterion).select(
        "recording_id", "segment_index", "start_frame", "k", F.size("stylized").alias("n"),
        F.size("breaks").alias("pieces"), F.round("cost", 4).alias("cost"), "error",
    )


@query("arr6_piecewise_stylize_mae")
def _(spark, d):
    return _styled_rows(spark, d, "mae")


@query("arr6_piecewise_stylize_mse")
def _(spark, d):
    return _styled_rows(spark, d, "mse")


TWO_PIECES = """SELECT recording_id, start_frame, round(min(c), 3) AS cost FROM (
  SELECT p.recording_id, p.start_frame, p.s, any_value(p.cost) + sum(pow(f.f0 - p.v, 2)) - CASE WHEN sum(pow(f.i - p.s, 2)) > 0 THEN
      pow(sum((f.i - p.s) * (f.f0 - p.v)), 2) / sum(pow(f.i - p.s, 2)) ELSE 0 END AS c
  FROM (SELECT recording_id, start_frame, s, a + b * s AS v, (SELECT sum(pow(x.f0 - l.a - l.b * x.i, 2)) FROM g x
        WHERE x.recording_id = l.recording_id AND x.start_frame = l.start_frame AND x.i <= l.s) AS cost
      FROM (SELECT e.recording_id, e.start_frame, e.i AS s, regr_intercept(f.f0, f.i) AS a, regr_slope(f.f0, f.i) AS b
        FROM g e JOIN g f ON f.recording_id = e.recording_id AND f.start_frame = e.start_frame AND f.i <= e.i
        WHERE e.i >= 2 AND e.i < e.n GROUP BY ALL) l) p
  JOIN g f ON f.recording_id = p.recording_id AND f.start_frame = p.start_frame AND f.i >= p.s GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(
    "arr6_two_pieces_mse",
    sql(TWO_PIECES, "runs").replace(
        "\nSELECT recording_id, start_frame, round(min(c), 3)",
        f""",\ng AS MATERIALIZED (SELECT *, frame_idx - start_frame + 1 AS i, count(*) OVER (PARTITION BY recording_id, start_frame) AS n
          FROM ({pieces_of_runs()}) QUALIFY n BETWEEN 4 AND 24)\nSELECT recording_id, start_frame, round(min(c), 3)""",
        1,
    ),
)
def _(spark, d):
    """Two pieces with a shared frame; the SQL tries every break."""
    short = voicing.voiced_segments(fx.pitch_frames(spark, d)).where(F.size("x").between(4, 24)).withColumn("k", F.lit(2))
    return stylize.stylize_segments(short, "mse").select("recording_id", "start_frame", F.round("cost", 3).alias("cost"))


@query(
    "arr6_single_line_cost",
    sql(
        f"""SELECT b.recording_id, b.start_frame, round(min(cost), 6) AS mae_cost, round(any_value(sq), 3) AS mse_cost
        FROM (SELECT p.recording_id, p.start_frame, p.i, p.j, sum(abs(f.f0 - (p.y + p.slope * (f.frame_idx - p.i)))) AS cost
          FROM (SELECT a.recording_id, a.start_frame, a.frame_idx AS i, b.frame_idx AS j, a.f0 AS y,
              (b.f0 - a.f0) / (b.frame_idx - a.frame_idx) AS slope FROM (FROM g) a JOIN (FROM g) b ON a.recording_id = b.recording_id
              AND a.start_frame = b.start_frame AND a.frame_idx < b.frame_idx) p
          JOIN g f ON f.recording_id = p.recording_id AND f.start_frame = p.start_frame GROUP BY ALL) b
        JOIN (SELECT recording_id, start_frame, sum(pow(f0 - (intercept + slope * (frame_idx - start_frame + 1)), 2)) AS sq
          FROM g JOIN ({LINES}) USING (recording_id, start_frame) GROUP BY 1, 2) s USING (recording_id, start_frame) GROUP BY 1, 2""",
        "runs",
    ).replace("\nSELECT b.recording_id", f",\ng AS MATERIALIZED ({pieces_of_runs()})\nSELECT b.recording_id", 1),
)
def _(spark, d):
    one = voicing.voiced_segments(fx.pitch_frames(spark, d)).withColumn("k", F.lit(1))
    key = ["recording_id", "start_frame"]
    absolute = stylize.stylize_segments(one, "mae").select(*key, F.round("cost", 6).alias("mae_cost"))
    square = stylize.stylize_segments(one, "mse").select(*key, F.round("cost", 3).alias("mse_cost"))
    return absolute.join(square, key)


@query(
    "arr7_empty_pitch_rows",
    sql(
        f"""SELECT recording_id, word_idx, n = 0 AS unvoiced, v0 IS NULL AND v1 IS NULL AND mean IS NULL AS all_null FROM ({STATS})""",
        "frames", "runs", "frame_words",
    ),
)
def _(spark, d):
    none = C("start_pitch").isNull() & C("end_pitch").isNull() & C("mean_pitch").isNull()
    return _pitch(spark, d).select(
        "recording_id", "word_idx", C("char_pitches").isNull().alias("unvoiced"), none.alias("all_null")
    )


# ---- streaming ---------------------------------------------------------------------------------------------------

EMITTED = """SELECT session_id, n AS trigger_seq, w0 AS window_start_ms, unnest(fresh) AS x, generate_subscripts(fresh, 1) - 1 AS pos
  FROM cursor_walk WHERE len(fresh) > 0"""


@query(
    "st1_live_word_dedup",
    sql(
        f"""SELECT session_id, trigger_seq, window_start_ms, pos, x.word AS word, x.s + window_start_ms AS start_ms,
        x.e + window_start_ms AS end_ms, x.c AS confidence FROM ({EMITTED})""",
        "cursor_walk",
    ),
)
def _(spark, d):
    return live.flat_words(streams.live_words_table(spark, d))


@query(
    "st2_sliding_context_window",
    sql(
        """SELECT session_id AS recording_id, trigger_seq, len(words) AS n_words, words[1].s + w0 AS first_ms,
        list_max([x.e FOR x IN words]) + w0 AS last_ms FROM windows WHERE len(words) > 0""",
        "windows",
    ),
)
def _(spark, d):
    last = fx.words(spark, d).groupBy("recording_id").agg((F.expr("max(end_ms) div 2000") + 1).alias("last_trigger"))
    return live.sliding_windows(fx.words(spark, d), last)


GATED = """SELECT recording_id, seq, seq + 1 AS n_chunks, e AS audio_end_ms FROM gate_walk WHERE i > 0 AND given = e - 400"""


@query("st3_trigger_gate", sql(GATED, "gate_walk"))
def _(spark, d):
    return gate.trigger_gate(fx.audio_chunks(spark, d))


@query("st3_trigger_gate_stream", sql(GATED, "gate_walk"))
def _(spark, d):
    return streams.gate_table(spark, d)


@query(
    "st4_session_finalize",
    sql(
        """SELECT recording_id, count(*) AS n_chunks, CASE WHEN recording_id % 4 = 0 THEN 'disconnect' ELSE 'stop' END AS reason
        FROM chunk_texts GROUP BY 1""",
        "chunk_texts",
    ),
)
def _(spark, d):
    return streams.finished_sessions_table(spark, d)


@query(
    "st5_utterance_sessions",
    sql(
        """SELECT recording_id, CAST(u AS BIGINT) AS utterance, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words
        FROM (SELECT *, sum(CASE WHEN start_ms - pe >= 1200 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY word_idx) AS u
          FROM (SELECT *, lag(end_ms) OVER (PARTITION BY recording_id ORDER BY word_idx) AS pe FROM words)) GROUP BY ALL""",
        "words",
    ),
)
def _(spark, d):
    return chunks.utterances(fx.words(spark, d))


@query(
    "st6_late_and_cutoff_words",
    sql(
        """SELECT c.session_id, c.n AS trigger_seq, len(w.words) AS n_words, len(c.fresh) AS n_emitted,
        len([x FOR x IN w.words IF x.e > w.len - 400]) AS n_deferred
        FROM cursor_walk c JOIN windows w ON w.session_id = c.session_id AND w.trigger_seq = c.n WHERE len(c.fresh) > 0""",
        "cursor_walk", "windows",
    ),
)
def _(spark, d):
    windows = fx.live_windows(spark, d).select("session_id", "trigger_seq", "window_len_ms", C("words").alias("seen"))
    deferred = F.filter("seen", lambda w: w["end_ms"] > C("window_len_ms") - live.GUARD_MS)
    return streams.live_words_table(spark, d).join(windows, ["session_id", "trigger_seq"]).select(
        "session_id", "trigger_seq", F.size("seen").cast("bigint").alias("n_words"),
        F.size("words").cast("bigint").alias("n_emitted"), F.size(deferred).cast("bigint").alias("n_deferred"),
    )


@query(
    "st7_preview_accumulate",
    sql(
        f"""SELECT session_id, trigger_seq, text, n_words,
        coalesce(sum(length(text) + 1) OVER (PARTITION BY session_id ORDER BY trigger_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
        (sum(length(text) + 1) OVER (PARTITION BY session_id) - 1)::BIGINT AS total_chars
        FROM (SELECT session_id, trigger_seq, string_agg(x.word, ' ' ORDER BY pos) AS text, count(*) AS n_words
          FROM ({EMITTED}) GROUP BY 1, 2)""",
        "cursor_walk",
    ),
)
def _(spark, d):
    return live.preview_text(streams.live_words_table(spark, d))


@query(
    "st7_preview_replace",
    sql(
        f"""SELECT session_id, trigger_seq, text, n_words,
        coalesce(sum(length(text) + 1) OVER (PARTITION BY session_id ORDER BY trigger_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
        (sum(length(text) + 1) OVER (PARTITION BY session_id) - 1)::BIGINT AS total_chars
        FROM (SELECT session_id, trigger_seq, string_agg(x.word, ' ' ORDER BY pos) AS text, count(*) AS n_words
          FROM (SELECT *, max(CASE WHEN trigger_seq % 10 = 0 THEN trigger_seq END) OVER (PARTITION BY session_id) AS f FROM ({EMITTED}))
          WHERE f IS NULL OR trigger_seq >= f GROUP BY 1, 2)""",
        "cursor_walk",
    ),
)
def _(spark, d):
    return live.preview_text(streams.live_words_table(spark, d), replace=C("trigger_seq") % 10 == 0)


@query(
    "st8_progress_stream",
    sql("SELECT *, status IN ('complete', 'failed') AS terminal FROM job_state", "job_state"),
)
def _(spark, d):
    return streams.progress_table(spark, d)


@query(
    "st9_live_stress_merge",
    sql(
        """SELECT session_id, trigger_seq, pos, word, CASE WHEN here IS NOT NULL AND (starts_with(t, here.t) OR starts_with(here.t, t))
          THEN here.l = 1 ELSE coalesce(f.l = 1, false) END AS stressed
        FROM (SELECT w.session_id, w.trigger_seq, w.pos, w.x.word AS word, lower(trim(w.x.word)) AS t,
            labels[w.pos + 1] AS here, [y FOR y IN labels IF y.t = lower(trim(w.x.word))][1] AS f
          FROM (SELECT session_id, trigger_seq, unnest(words) AS x, generate_subscripts(words, 1) - 1 AS pos FROM windows) w
          JOIN (SELECT session_id, trigger_seq, [{'t': lower(trim(CASE WHEN x.i % 41 = 0 THEN '' WHEN x.i % 7 = 0 THEN 'zz' || x.word
              ELSE x.word END)), 'l': CASE WHEN (length(x.word) + x.i) % 4 = 0 THEN 1 ELSE 0 END} FOR x IN words IF x.i % 23 <> 0] AS labels
            FROM windows) l ON l.session_id = w.session_id AND l.trigger_seq = w.trigger_seq)""",
        "windows",
    ),
)
def _(spark, d):
    windows, labels = streams.window_labels(spark, d)
    rows = live.window_stress(windows, labels)
    return rows.select("session_id", "trigger_seq", F.posexplode("words").alias("pos", "w")).select(
        "session_id", "trigger_seq", "pos", "w.word", "w.stressed"
    )


# ---- analyzers and hooks -----------------------------------------------------------------------------------------


@query(
    "udf1_udf2_analyzer_registry",
    sql(
        f"""SELECT w.recording_id, w.word_idx, w.word_idx // 4 AS phrase_index, {DIRECTION} AS pitch_direction,
        round(s.mean, 6) AS mean_pitch FROM frame_words w JOIN ({INTON}) USING (recording_id, word_idx)
        JOIN (SELECT recording_id, word_idx, mean FROM ({STATS})) s USING (recording_id, word_idx)""",
        "frames", "runs", "frame_words",
    ),
)
def _(spark, d):
    tables = {
        "pitch_frames": fx.pitch_frames(spark, d),
        "intonation_frames": fx.pitch_frames(spark, d, "b").select("recording_id", "frame_idx", "f0"),
        "criterion": "none",
    }
    # No stress labels are given here: that analyzer is skipped and its defaults stand in.
    rows = sessions.analyze(fx.frame_words(spark, d), tables, sessions.default_registry(pitch=True, intonation=True))
    return rows.select("recording_id", "word_idx", "phrase_index", "pitch_direction", r6("mean_pitch"))


def _load_counter():
    return len


@query(
    "udf3_udf5_batch_model_hook",
    sql("SELECT recording_id, seq, CASE WHEN strlen(content) % 3 <> 0 THEN strlen(content) END AS n_bytes,"
        " CASE WHEN strlen(content) % 3 = 0 THEN 'ValueError: unreadable' END AS error FROM chunk_texts", "chunk_texts"),
)
def _(spark, d):
    from pyspark.sql import types as T

    def predict(model, rows):
        sizes = rows["content"].map(model)
        if (sizes % 3 == 0).any():
            raise ValueError("unreadable")
        return sizes.to_frame("n_bytes")

    items = fx.audio_chunks(spark, d).filter(C("kind") == "audio").select("recording_id", "seq", "content")
    out = T.StructType([T.StructField("n_bytes", T.LongType())])
    return model_hook(items, "counter", _load_counter, predict, ["recording_id", "seq"], out)


@query(
    "udf4_stress_label_normalize",
    sql("SELECT recording_id, phrase_index, pos, trim(word) AS word, label = 1 AS stressed,"
        " CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS stress_score FROM labels_raw", "labels_raw"),
)
def _(spark, d):
    return stress.normalize_labels(fx.stress_labels(spark, d))


# ---- quality -----------------------------------------------------------------------------------------------------


@query(
    "qa1_word_checks",
    sql("SELECT recording_id, count(*) AS n_words, 0 AS untimed, count(*) FILTER (NOT confidence BETWEEN 0 AND 1) AS bad_confidence,"
        " true AS has_words FROM words GROUP BY 1", "words"),
)
def _(spark, d):
    return quality.word_checks(fx.words(spark, d), fx.recordings(spark, d))


@query("qa2_chunk_checks", chunk_sql(CHECKS.format(bound=20_000)))
def _(spark, d):
    return chunks.order_checks(_chunks(spark, d), bound_ms=20_000)


@query(
    "qa3_word_pitch_checks",
    sql(
        f"SELECT recording_id, count(*) AS n_words, count(mean) AS n_voiced, 0 AS bad_chars, 0 AS unvoiced_with_values FROM ({STATS}) GROUP BY 1",
        "frames", "runs", "frame_words",
    ),
)
def _(spark, d):
    return quality.word_pitch_checks(_pitch(spark, d), tokens.char_count(C("word")))


@query(
    "qa3_stylization_checks",
    sql(f"SELECT recording_id, count(*) AS n_segments, 0 AS bad_length, 0 AS negative_cost FROM ({SEGMENT_ROWS}) GROUP BY 1", "runs"),
)
def _(spark, d):
    return quality.stylization_checks(_styled(spark, d, "mae"))


@query(
    "qa4_tone_check",
    sql("SELECT recording_id, round(avg(f0), 6) AS mean_f0, avg(f0) BETWEEN 100 AND 160 AS within FROM frames GROUP BY 1", "frames"),
)
def _(spark, d):
    return quality.tone_check(fx.pitch_frames(spark, d), 100.0, 160.0).withColumn("mean_f0", F.round("mean_f0", 6))


@query(
    "qa5_job_state_checks",
    sql("SELECT count(*) AS n_jobs, 0 AS bad_status, 0 AS bad_progress FROM job_state", "job_state"),
)
def _(spark, d):
    return quality.state_checks(jobs.job_state(fx.job_events(spark, d)), JOB_STATUSES)


# Planted violations of every rule, by arithmetic on the keys.
DAMAGED_WORDS = """SELECT * REPLACE (CASE WHEN word_idx % 31 = 7 THEN NULL ELSE start_ms END AS start_ms,
  CASE WHEN word_idx % 37 = 5 THEN start_ms - 1 WHEN word_idx % 41 = 3 THEN NULL ELSE end_ms END AS end_ms,
  CASE WHEN word_idx % 29 = 2 THEN 1.25 WHEN word_idx % 43 = 1 THEN -0.01 WHEN word_idx % 47 = 0 THEN NULL ELSE confidence END AS confidence)
  FROM words WHERE recording_id % 9 <> 4"""
DAMAGED_STATE = """SELECT * REPLACE (CASE WHEN job_id % 13 = 0 THEN 'lost' WHEN job_id % 17 = 0 THEN NULL ELSE status END AS status,
  CASE WHEN job_id % 11 = 0 THEN 1.5 WHEN job_id % 19 = 0 THEN -0.5 ELSE progress END AS progress,
  CASE WHEN job_id % 23 = 0 THEN started_at - INTERVAL 1 SECOND ELSE completed_at END AS completed_at) FROM job_state"""


def _damaged_words(spark, d):
    i, ms = C("word_idx"), C("start_ms")
    return fx.words(spark, d).where("recording_id % 9 <> 4").withColumns({
        "start_ms": F.when(i % 31 != 7, ms),
        "end_ms": F.when(i % 37 == 5, ms - 1).when(i % 41 != 3, C("end_ms")),
        "confidence": F.when(i % 29 == 2, 1.25).when(i % 43 == 1, -0.01).when(i % 47 != 0, C("confidence")),
    })


def _damaged_state(spark, d):
    job = C("job_id")
    return jobs.job_state(fx.job_events(spark, d)).withColumns({
        "status": F.when(job % 13 == 0, "lost").when(job % 17 != 0, C("status")),
        "progress": F.when(job % 11 == 0, 1.5).when(job % 19 == 0, -0.5).otherwise(C("progress")),
        "completed_at": F.when(job % 23 == 0, C("started_at") - F.expr("INTERVAL '1' SECOND")).otherwise(C("completed_at")),
    })


@query(
    "qa1_planted_violations",
    sql(
        f"""SELECT r.recording_id, count(w.recording_id) AS n_words, count(*) FILTER (w.recording_id IS NOT NULL AND (start_ms IS NULL OR end_ms IS NULL)) AS untimed,
        count(*) FILTER (confidence < 0 OR confidence > 1) AS bad_confidence, count(w.recording_id) > 0 AS has_words
        FROM (SELECT DISTINCT recording_id FROM words) r LEFT JOIN ({DAMAGED_WORDS}) w ON w.recording_id = r.recording_id GROUP BY 1""",
        "words",
    ),
)
def _(spark, d):
    return quality.word_checks(_damaged_words(spark, d), fx.recordings(spark, d))


@query(
    "qa3_planted_violations",
    sql(
        f"""SELECT recording_id, count(*) AS n_words, count(*) FILTER (voiced) AS n_voiced, count(*) FILTER (voiced AND word_idx % 7 = 3) AS bad_chars,
        count(*) FILTER (NOT voiced AND word_idx % 2 = 1) AS unvoiced_with_values FROM (SELECT recording_id, word_idx, mean IS NOT NULL AS voiced FROM ({STATS}))
        GROUP BY 1""",
        "frames", "runs", "frame_words",
    ),
)
def _(spark, d):
    """One value too many for some voiced words, values for some unvoiced ones."""
    i, kept = C("word_idx"), C("char_pitches")
    pitched = _pitch(spark, d).withColumn(
        "char_pitches",
        F.when(C("mean_pitch").isNull() & (i % 2 == 1), F.array(F.lit(1.0)))
        .when(C("mean_pitch").isNotNull() & (i % 7 == 3), F.array_append(kept, F.lit(1.0))).otherwise(kept),
    )
    return quality.word_pitch_checks(pitched, tokens.char_count(C("word")))


@query(
    "qa3_planted_stylization",
    sql(
        f"""SELECT recording_id, count(*) AS n_segments, count(*) FILTER (start_frame % 3 = 0) AS bad_length,
        count(*) FILTER (start_frame % 5 = 0) AS negative_cost FROM ({SEGMENT_ROWS}) GROUP BY 1""",
        "runs",
    ),
)
def _(spark, d):
    at = C("start_frame")
    damaged = _styled(spark, d, "mse").withColumns({
        "stylized": F.when(at % 3 == 0, F.array_append("stylized", F.lit(0.0))).otherwise(C("stylized")),
        "cost": F.when(at % 5 == 0, -1.0 - F.abs("cost")).otherwise(C("cost")),
    })
    return quality.stylization_checks(damaged)


def _observed(spark, rows, rules, name):
    """Counts taken while the rows are written."""
    watched = quality.Watched(rows, rules, name)
    cut(watched.rows, name)
    counts = watched.counts()
    return spark.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in counts.items()])


@query(
    "qa1_observed_words",
    sql(
        f"""SELECT count(*) AS n_rows, count(*) FILTER (start_ms IS NULL OR end_ms IS NULL) AS untimed,
        count(*) FILTER (confidence < 0 OR confidence > 1) AS bad_confidence, count(*) FILTER (end_ms < start_ms) AS backwards FROM ({DAMAGED_WORDS})""",
        "words",
    ),
)
def _(spark, d):
    return _observed(spark, _damaged_words(spark, d), quality.WORD_RULES, "words")


@query(
    "qa5_observed_jobs",
    sql(
        f"""SELECT count(*) AS n_rows, count(*) FILTER (status NOT IN ('queued', 'processing', 'complete', 'failed')) AS bad_status,
        count(*) FILTER (progress < 0 OR progress > 1) AS bad_progress, count(*) FILTER (completed_at < started_at) AS ended_before_start FROM ({DAMAGED_STATE})""",
        "job_state",
    ),
)
def _(spark, d):
    return _observed(spark, _damaged_state(spark, d), quality.JOB_RULES, "jobs")


@query(
    "qa5_planted_violations",
    sql(
        f"""SELECT count(*) AS n_jobs, count(*) FILTER (status NOT IN ('queued', 'processing', 'complete', 'failed')) AS bad_status,
        count(*) FILTER (progress < 0 OR progress > 1) AS bad_progress FROM ({DAMAGED_STATE})""",
        "job_state",
    ),
)
def _(spark, d):
    return quality.state_checks(_damaged_state(spark, d), JOB_STATUSES)


# ---- end to end --------------------------------------------------------------------------------------------------


@query(
    "session_overview",
    sql(
        f"""SELECT s.*, CAST(t.pause_ms AS BIGINT) AS pause_ms, t.long_pauses, t.hesitations, c.avg_confidence_pct FROM ({SUMMARY}) s
        JOIN (SELECT recording_id, sum(pause_after_ms) AS pause_ms, count(*) FILTER (pause_after_ms > 500) AS long_pauses,
          count(*) FILTER (is_hesitation) AS hesitations FROM phrased GROUP BY 1) t USING (recording_id)
        JOIN (SELECT recording_id, CAST(round(avg(confidence) * 100) AS BIGINT) AS avg_confidence_pct FROM absorbed GROUP BY 1) c
          USING (recording_id)""",
        "recordings", "stressed", "phrased", "absorbed",
    ),
)
def session_overview(spark, d):
    rows = sessions.session_overview(_featured(spark, d), fx.recordings(spark, d))
    return rows.withColumn("stress_ratio", F.round("stress_ratio", 6))


def _chunk_words(spark, d):
    """Words with times relative to the speech chunk they start in."""
    cell = 10_000
    spans = _chunks(spark, d).select(
        "recording_id", "chunk_index", C("start_ms").alias("c0"), "start_sample", "end_sample",
        F.explode(F.expr(f"sequence(start_sample div {16 * cell}, end_sample div {16 * cell})")).alias("cell"),
    )
    words = fx.words(spark, d).withColumn("cell", F.expr(f"start_ms div {cell}"))
    at = C("start_ms") * 16
    inside = words.join(spans, ["recording_id", "cell"]).filter((at >= C("start_sample")) & (at <= C("end_sample")))
    # A word on a shared border belongs to the later chunk.
    return (
        inside.groupBy("recording_id", "word_idx")
        .agg(F.max_by(F.struct("chunk_index", "word", "start_ms", "end_ms", "confidence", "c0"), "chunk_index").alias("m"))
        .select("recording_id", "word_idx", "m.*")
        .withColumns({"start_ms": C("start_ms") - C("c0"), "end_ms": C("end_ms") - C("c0")})
        .drop("c0")
    )
