"""Input tables derived from the driver tables with integer arithmetic, so that any engine gives the same rows.

The shared ones are staged once per application and source folder (see ``lilt.session``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lilt.operators.phrases import phrase_words
from lilt.operators.scan import Run, adjacent, attach, running
from lilt.session import staged, staged_path

TRIGGER_MS = 2000
WINDOW_MS = 8000
REC = ["recording_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("recording_id"),
        "turn",
        F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("tokens"),
    )
    based = running(
        turns,
        REC,
        "turn",
        {"base": Run("sum", F.size("tokens").cast("bigint"), inclusive=False)},
        blocks=[F.expr("turn div 1024")],
    )
    spoken = based.select("recording_id", "turn", "base", F.posexplode("tokens").alias("p", "token")).select(
        "recording_id", "turn", (F.col("base") + F.col("p")).alias("word_idx"), "token"
    )
    rec, wi, word = F.col("recording_id"), F.col("word_idx"), F.col("word")
    timed = spoken.withColumn(
        "word", F.when(wi % 17 == 5, "um").when(wi % 29 == 3, "a").otherwise(F.col("token"))
    ).withColumns(
        {
            "dur": F.when(wi % 58 == 3, F.lit(400)).otherwise(60 * F.length(word) + 40).cast("bigint"),
            "gap": 40 * ((wi * 37 + rec * 13) % 11)
            - 40
            + F.when(word.rlike("[.?!]$"), 700).when(word.endswith(","), 400).otherwise(0)
            + F.when(wi % 53 == 52, 1100).otherwise(0),
        }
    )
    placed = running(
        timed, REC, "word_idx", {"start_ms": Run("sum", F.col("dur") + F.col("gap"), inclusive=False)}
    )
    return placed.select(
        "recording_id",
        "word_idx",
        "turn",
        "word",
        "start_ms",
        (F.col("start_ms") + F.col("dur")).alias("end_ms"),
        ((100 - (wi * 7 + rec) % 45) / 100.0).alias("confidence"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "words", sf_dir, lambda: _words(spark, sf_dir))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        words(spark, sf_dir)
        .groupBy("recording_id")
        .agg((F.max("end_ms") + 200).alias("duration_ms"))
        .withColumn("sample_rate", F.lit(16000))
    )


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with phrase, position, pause and hesitation flag."""
    return staged(spark, "phrased", sf_dir, lambda: phrase_words(words(spark, sf_dir).drop("turn")))


def asr_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested recogniser output, one row per turn; tokens keep the leading space recognisers emit."""
    conv = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("recording_id"), F.col("turn").alias("seg_idx"), F.concat(F.lit(" "), "text").alias("text")
    )
    nested = (
        words(spark, sf_dir)
        .groupBy("recording_id", F.col("turn").alias("seg_idx"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "word_idx",
                        F.concat(F.lit(" "), "word").alias("word"),
                        (F.col("start_ms") / 1000.0).alias("start_s"),
                        (F.col("end_ms") / 1000.0).alias("end_s"),
                        F.col("confidence").alias("probability"),
                    )
                )
            ).alias("words")
        )
        .withColumn(
            "words",
            F.transform("words", lambda w: F.struct(w["word"].alias("word"), w["start_s"].alias("start_s"),
                                                    w["end_s"].alias("end_s"), w["probability"].alias("probability"))),
        )
    )
    return conv.join(nested, ["recording_id", "seg_idx"], "left").select(
        "recording_id",
        "seg_idx",
        "text",
        ((F.col("recording_id") * 31 + F.col("seg_idx") * 17) % 100 / 100.0).alias("no_speech_prob"),
        "words",
    )


def stress_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    wi = F.col("word_idx")
    word = F.col("word")
    return (
        phrased(spark, sf_dir)
        .filter(wi % 23 != 0)
        .select(
            "recording_id",
            "phrase_index",
            "pos",
            F.when(wi % 41 == 0, "")
            .when(wi % 7 == 0, F.concat(F.lit("zz"), word))
            .when(wi % 5 == 0, F.expr("substring(word, 1, length(word) - 1)"))
            .otherwise(word)
            .alias("word"),
            F.when((F.length(word) + wi) % 4 == 0, 1).otherwise(0).alias("label"),
        )
    )


def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = words(spark, sf_dir).select("recording_id", "word_idx", "start_ms", "end_ms")
    gapped = adjacent(base, REC, "word_idx", lag={"prev_end": F.col("end_ms")}, keep="_block")
    opens = F.when(F.col("start_ms") - F.col("prev_end") >= 500, 1).otherwise(0).cast("bigint")
    return (
        running(gapped, REC, "word_idx", {"seg_idx": Run("sum", opens)}, [F.col("_block")])
        .groupBy("recording_id", "seg_idx")
        .agg((F.min("start_ms") * 16).alias("start_sample"), (F.max("end_ms") * 16).alias("end_sample"))
        .filter(F.col("recording_id") % 25 != 7)
    )


def staged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "speech_segments", sf_dir, lambda: speech_segments(spark, sf_dir))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"),
        "event_id",
        "event_type",
        F.struct("ts", "event_id").alias("at"),
        F.expr("datediff(to_date(ts), DATE'1970-01-01') * 24 + hour(ts)").alias("hour"),
        "value",
    )
    ranked = running(
        events,
        REC,
        "at",
        {"rank": Run("sum", F.lit(1).cast("bigint"))},
        blocks=[F.col("hour"), F.expr("hour div 168")],
    )
    voiced = (F.lit(80) + F.col("value")) * F.when(
        (F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0), 2
    ).otherwise(1)
    return ranked.select(
        "recording_id",
        (F.col("rank") - 1).alias("frame_idx"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.lit(None)).otherwise(voiced).alias("f0"),
        "event_type",
    )


def _staged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "pitch_frames", sf_dir, lambda: _frames(spark, sf_dir))


def pitch_frames(spark: SparkSession, sf_dir: str, tracker: str = "a") -> DataFrame:
    hop = {"a": 10, "b": 32}[tracker]
    return _staged_frames(spark, sf_dir).select(
        "recording_id", F.lit(tracker).alias("tracker"), F.lit(hop).alias("hop_ms"), "frame_idx", "f0"
    )


def frame_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words aligned to the frames: every 8 frames, 7 frames long."""
    j = F.col("frame_idx") / 8
    return (
        _staged_frames(spark, sf_dir)
        .filter(F.col("frame_idx") % 8 == 0)
        .select(
            "recording_id",
            j.cast("bigint").alias("word_idx"),
            F.concat("event_type", F.when(j.cast("bigint") % 4 == 3, ".").otherwise("")).alias("word"),
            (F.col("frame_idx") * 10).alias("start_ms"),
            (F.col("frame_idx") * 10 + 60).alias("end_ms"),
            F.lit(1.0).alias("confidence"),
        )
    )


def frame_phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "frame_phrased", sf_dir, lambda: phrase_words(frame_words(spark, sf_dir)))


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")

    def write(seq, seconds, kind, **columns):
        fields = {
            "status": F.lit(None).cast("string"),
            "progress": F.lit(None).cast("double"),
            "total_chunks": F.lit(None).cast("int"),
            "completed_chunks": F.lit(None).cast("int"),
            "current_stage": F.lit(None).cast("string"),
            "result": F.lit(None).cast("string"),
            "error": F.lit(None).cast("string"),
        } | columns
        return F.struct(
            F.lit(seq).alias("seq"),
            (F.col("o_orderdate") + F.expr(f"INTERVAL '{seconds}' SECOND")).alias("event_ts"),
            F.lit(kind).alias("write"),
            *[c.alias(n) for n, c in fields.items()],
        )

    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    # Phrases of two words; in some documents the second word lacks its start.
    second = F.when(key % 73 == 0, F.lit("")).otherwise(F.lit('"start": 1.25, '))
    phrase = lambda k: text(
        f'{{"phrase_index": {k}, "text": "w', key % 7, ' v", "words": [{"word": "w', key % 7, f'", "start": {k}.5, "end": {k}.75, "stressed": true}}, '
        '{"word": "v", ', second, f'"end": "1.5", "confidence": 0.5, "extra": [1]}}], "start_time": {k}.5, "end_time": 9, "chunk_index": "{k}"}}',
    )
    phrases = F.when(key % 3 == 0, text(', "phrases": [', phrase(0), ", ", phrase(1), "]")).otherwise("")
    body = text('{"total_duration": ', key % 600, '.5, "word_count": ', key % 1000, phrases, "}")
    body = (
        F.when(key % 97 == 0, F.lit('{"word_count": '))
        .when(key % 89 == 0, F.lit('{"word_count": "many"}'))
        .when(key % 83 == 0, F.lit('{"word_count": "12", "total_duration": "2.5", "phrases": []}'))
        .when(key % 79 == 0, F.lit("{}"))
        .when(key % 71 == 0, F.lit("[1]"))
        .otherwise(body)
    )
    partial = F.when(key % 5 == 0, F.lit('{"word_count": null}')).otherwise(F.lit('{"word_count": 1}'))
    chunks = (key % 7 + 1).cast("int")
    failed = key % 50 == 0
    created = [write(0, 0, "create", status=F.lit("queued"), progress=F.lit(0.0), result=F.lit("{}"))]
    begun = [
        write(1, 2, "status", status=F.lit("processing")),
        write(2, 9, "status", status=F.lit("processing"), total_chunks=chunks),
        write(3, 10, "progress", progress=F.lit(0.5), completed_chunks=F.lit(1), current_stage=F.lit("analyzing"),
              result=partial),
    ]
    closed = [
        write(
            4, 20, "status",
            status=F.when(failed, "failed").otherwise("complete"),
            progress=F.when(~failed, F.lit(1.0)),
            completed_chunks=F.when(~failed, chunks),
            current_stage=F.when(~failed, F.lit("done")),
            result=F.when(~failed, body),
            error=F.when(failed, F.lit("ValueError: bad audio")),
        )
    ]
    writes = (
        F.when(status == "F", F.array(*created, *begun, *closed))
        .when(status == "P", F.array(*created, *begun))
        .otherwise(F.array(*created))
    )
    return table(spark, sf_dir, "orders").select(key.alias("job_id"), F.inline(writes))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "job_events", sf_dir, lambda: _job_events(spark, sf_dir))


def job_events_path(spark: SparkSession, sf_dir: str) -> str:
    job_events(spark, sf_dir)
    return staged_path(spark, "job_events", sf_dir)


def _audio_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 20).alias("recording_id"), "page_id", F.encode("html", "UTF-8").alias("content")
    )
    ranked = running(
        pages,
        REC,
        "page_id",
        {"rank": Run("sum", F.lit(1).cast("bigint"))},
        blocks=[F.expr("page_id div 65536")],
    ).withColumn("seq", F.col("rank") - 1)
    repeated = adjacent(ranked, REC, "seq", lag={"before": F.col("content")}).select(
        "recording_id",
        "seq",
        F.lit("audio").alias("kind"),
        F.when((F.col("page_id") % 11 == 0) & F.col("before").isNotNull(), F.col("before"))
        .otherwise(F.col("content"))
        .alias("content"),
    )
    stops = (
        ranked.groupBy("recording_id")
        .agg((F.max("seq") + 1).alias("seq"))
        .select(
            "recording_id",
            "seq",
            F.when(F.col("recording_id") % 4 == 0, "disconnect").otherwise("stop").alias("kind"),
            F.lit(None).cast("binary").alias("content"),
        )
    )
    silent = stops.filter(F.col("recording_id") == 3).withColumns(
        {"recording_id": F.lit(99).cast("bigint"), "seq": F.lit(0).cast("bigint")}
    )
    return repeated.unionByName(stops).unionByName(silent).withColumns({
        "recv_ms": F.lit(1_700_000_000_000) + F.col("recording_id") * 10_000_000 + F.col("seq") * 1000,
        # Less than half the audio that a run needs, so that many chunks pass between two runs.
        "audio_ms": F.when(F.col("kind") == "audio", 60 + (F.col("seq") * 97 + F.col("recording_id") * 13) % 640),
    })


def audio_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 20 sessions; three in four stop, the others disconnect; session 99 stops without any audio."""
    return staged(spark, "audio_chunks", sf_dir, lambda: _audio_chunks(spark, sf_dir))


def audio_chunks_path(spark: SparkSession, sf_dir: str) -> str:
    audio_chunks(spark, sf_dir)
    return staged_path(spark, "audio_chunks", sf_dir)


def pcm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        (vec % 50).alias("recording_id"),
        F.expr("vec_id div 50").alias("block_idx"),
        F.expr("(vec_id div 50) * 64").alias("start_sample"),
        F.col("embedding").alias("samples"),
    )


def _triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live triggers of each recording, up to the one behind its last word."""
    ends = words(spark, sf_dir).groupBy("recording_id").agg(F.max("end_ms").alias("last_ms"))
    span = 4096
    return (
        ends.withColumn("n", F.expr(f"last_ms div {TRIGGER_MS} + 1"))
        .select("recording_id", "n", F.explode(F.expr(f"sequence(0, (n - 1) div {span})")).alias("part"))
        .repartition("recording_id", "part")
        .select(
            "recording_id",
            F.explode(F.expr(f"sequence(part * {span} + 1, least(n, (part + 1) * {span}))")).alias("trigger_seq"),
        )
    )


def _live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers = _triggers(spark, sf_dir)
    reach = F.expr(
        f"sequence(greatest(1, (end_ms + {TRIGGER_MS - 1}) div {TRIGGER_MS}), "
        f"(start_ms + {WINDOW_MS}) div {TRIGGER_MS})"
    )
    inside = (
        words(spark, sf_dir)
        .filter(F.expr(f"(end_ms + {TRIGGER_MS - 1}) div {TRIGGER_MS} <= (start_ms + {WINDOW_MS}) div {TRIGGER_MS}"))
        .select("recording_id", "word_idx", "word", "start_ms", "end_ms", "confidence", F.explode(reach).alias("trigger_seq"))
        .withColumn("w0", F.greatest(F.lit(0), F.col("trigger_seq") * TRIGGER_MS - WINDOW_MS))
        .groupBy("recording_id", "trigger_seq")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "word_idx",
                        "word",
                        (F.col("start_ms") - F.col("w0")).alias("start_ms"),
                        (F.col("end_ms") - F.col("w0")).alias("end_ms"),
                        "confidence",
                    )
                )
            ).alias("found")
        )
    )
    edge = F.col("trigger_seq") * TRIGGER_MS
    return triggers.join(inside, ["recording_id", "trigger_seq"], "left").select(
        F.col("recording_id").alias("session_id"),
        "trigger_seq",
        F.greatest(F.lit(0), edge - WINDOW_MS).alias("window_start_ms"),
        F.least(F.lit(WINDOW_MS), edge).alias("window_len_ms"),
        F.coalesce(
            F.expr("transform(found, f -> struct(f.word as word, f.start_ms as start_ms, f.end_ms as end_ms,"
                   " f.confidence as confidence))"),
            F.expr("cast(array() as array<struct<word:string,start_ms:bigint,end_ms:bigint,confidence:double>>)"),
        ).alias("words"),
    )


def live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "live_windows", sf_dir, lambda: _live_windows(spark, sf_dir))


def _live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word once, with the first and last window that hold it, and the windows with their number of words."""
    first, last = (F.expr(e) for e in (f"greatest(1, (end_ms + {TRIGGER_MS - 1}) div {TRIGGER_MS})", f"(start_ms + {WINDOW_MS}) div {TRIGGER_MS}"))
    none = lambda kind: F.lit(None).cast(kind)
    triggers = _triggers(spark, sf_dir)
    ends = words(spark, sf_dir).groupBy("recording_id").agg((F.expr(f"max(end_ms) div {TRIGGER_MS}") + 1).alias("n"))
    heard = words(spark, sf_dir).select(
        F.col("recording_id").alias("session_id"), first.alias("first_seq"), last.alias("last_seq"), "word_idx", "word", "start_ms", "end_ms", "confidence"
    ).where("first_seq <= last_seq")
    # The live edge never passes the end of the audio, so neither does a word's last window.
    spread = F.expr("word_idx div 65536")
    ended = attach(heard, ends.withColumnRenamed("recording_id", "session_id"), ["session_id"], spread, "inner")
    heard = ended.withColumn("last_seq", F.least("last_seq", "n")).drop("n")
    counted = heard.select(F.col("session_id").alias("recording_id"), F.explode(F.sequence("first_seq", "last_seq")).alias("trigger_seq")).groupBy(
        "recording_id", "trigger_seq").agg(F.count("*").cast("int").alias("n_words"))
    edge = F.col("trigger_seq") * TRIGGER_MS
    windows = triggers.join(counted, ["recording_id", "trigger_seq"], "left").select(
        F.col("recording_id").alias("session_id"), F.col("trigger_seq").alias("first_seq"), F.col("trigger_seq").alias("last_seq"),
        none("long").alias("word_idx"), none("string").alias("word"), F.greatest(F.lit(0), edge - WINDOW_MS).alias("start_ms"), edge.alias("end_ms"),
        none("double").alias("confidence"), F.coalesce("n_words", F.lit(0)).alias("n_words"),
        (F.col("trigger_seq") - 1).alias("after"),  # each trigger of a session has a row
    )
    events = heard.select("*", none("int").alias("n_words"), none("long").alias("after")).unionByName(windows)
    # A session after the other, so that a replay file by file holds few windows back, in whatever order it reads the files.
    return events.repartitionByRange("session_id", "first_seq").sortWithinPartitions("session_id", "first_seq")


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "live_events", sf_dir, lambda: _live_events(spark, sf_dir))


def live_events_path(spark: SparkSession, sf_dir: str) -> str:
    live_events(spark, sf_dir)
    return staged_path(spark, "live_events", sf_dir)


def casing_vocabulary(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """Tokens that the talk itself writes in lower case at least ``least`` times."""
    from lilt.functions.tokens import clean_token, starts_lower

    word = F.col("word")
    return (
        words(spark, sf_dir)
        .filter(starts_lower(word))
        .groupBy(clean_token(word).alias("token"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= least)
        .select("token")
    )
