"""Job lifecycle as an append-only event table and the state derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lilt.functions.documents import default_of, typed
from lilt.schemas import JOB_EVENTS, JOB_RESULT

# Results that count as none.
EMPTY_JSON = ("{}", "[]", '""', "0", "0.0", "false", "null")


#: Columns of which the last write counts, and what stands before any write.
LAST_WRITES = {
    "status": None, "progress": 0.0, "total_chunks": 0, "completed_chunks": 0, "current_stage": "", "result": None, "error": "",
}


def folded_events(events: DataFrame) -> DataFrame:
    """One partial fold per job: ``(event_ts, seq, value)`` of the last write of each column, and the times that count.

    All aggregates combine map-side, so a job with very many writes stays cheap.
    """
    begun = F.when(F.col("status") == "processing", F.col("event_ts"))
    ended = F.when(F.col("status").isin("complete", "failed"), F.col("event_ts"))
    created = F.when(F.col("write") == "create", F.col("event_ts"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("event_ts", "seq", F.col(c).alias("value"))))
    return events.groupBy("job_id").agg(
        *[last(c).alias(c) for c in LAST_WRITES],
        F.min(created).alias("created_at"),
        F.max(begun).alias("started_at"),
        F.min(begun).alias("first_started_at"),
        F.max(ended).alias("completed_at"),
    )


def folded_rows(rows: DataFrame, greatest: tuple[str, ...] = ()) -> DataFrame:
    """Partial folds of the same job put together; the order doesn't matter. Further columns keep their least value, those
    named in ``greatest`` their greatest."""
    times = {"created_at": F.min, "started_at": F.max, "first_started_at": F.min, "completed_at": F.max}
    more = [c for c in rows.columns if c not in (*LAST_WRITES, *times, "job_id")]
    return rows.groupBy("job_id").agg(
        *[F.max(c).alias(c) for c in LAST_WRITES], *[f(c).alias(c) for c, f in times.items()], *[(F.max if c in greatest else F.min)(c).alias(c) for c in more]
    )


def state_of(folds: DataFrame) -> DataFrame:
    """The state that folds stand for."""
    value = {c: F.col(c)["value"] if v is None else F.coalesce(F.col(c)["value"], F.lit(v)) for c, v in LAST_WRITES.items()}
    return folds.select(
        "job_id", value["status"].alias("status"), value["progress"].alias("progress"),
        "created_at", "started_at", "first_started_at", "completed_at",
        *[value[c].alias(c) for c in ("total_chunks", "completed_chunks", "current_stage", "result", "error")],
    )


def job_state(events: DataFrame) -> DataFrame:
    """Current row per job.

    ``started_at`` is the latest write of status processing, ``first_started_at`` the earliest.
    """
    return state_of(folded_events(events))


def find_job(state: DataFrame, job_id: int) -> DataFrame:
    """The job's row, or no row."""
    return state.filter(F.col("job_id") == job_id)


def next_queued(state: DataFrame) -> DataFrame:
    """Oldest queued job; equal times are resolved by id."""
    return state.filter(F.col("status") == "queued").orderBy("created_at", "job_id").limit(1)


def parse_results(state: DataFrame) -> DataFrame:
    """Adds ``document``: the job's result with its phrases and words, typed by ``JOB_RESULT``.

    Unreadable JSON counts as an empty result, and an empty one gives NULL. A document that breaks the model gives the
    default document for complete jobs and NULL for running ones. Other jobs have no document.
    """
    given = F.col("_json").isNotNull() & ~F.to_json("_json").isin(*EMPTY_JSON)
    sound, complete = F.col("_typed.ok"), F.col("status") == "complete"
    document = (
        F.when(given & sound & (complete | (F.col("status") == "processing")), F.col("_typed.v"))
        .when(given & ~sound & complete, default_of(JOB_RESULT))
    )
    parsed = state.withColumn("_json", F.try_parse_json("result")).withColumn("_typed", typed("_json", JOB_RESULT))
    return parsed.withColumn("document", document).drop("_json", "_typed")


def _event(source: DataFrame, **columns: Column) -> DataFrame:
    given = {f.name: F.lit(None).cast(f.dataType) for f in JOB_EVENTS} | columns
    return source.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in JOB_EVENTS])


def created_events(jobs: DataFrame, at: Column | None = None) -> DataFrame:
    """Queued rows for new jobs ``(job_id)``."""
    return _event(
        jobs, job_id=F.col("job_id"), seq=F.lit(0), event_ts=F.localtimestamp() if at is None else at,
        write=F.lit("create"), status=F.lit("queued"), progress=F.lit(0.0), result=F.lit("{}"),
    )


def status_events(jobs: DataFrame, status: str, at: Column | None = None, **columns: Column) -> DataFrame:
    """Status writes for jobs ``(job_id, seq)``; ``seq`` is the number of the write within the job."""
    return _event(
        jobs, job_id=F.col("job_id"), seq=F.col("seq"), event_ts=F.localtimestamp() if at is None else at,
        write=F.lit("status"), status=F.lit(status), **columns,
    )


def progress_events(jobs: DataFrame, at: Column | None = None) -> DataFrame:
    """Progress writes for ``(job_id, seq, progress, completed_chunks, current_stage, result)``; result may be NULL."""
    names = ["job_id", "seq", "progress", "completed_chunks", "current_stage", "result"]
    return _event(
        jobs, event_ts=F.localtimestamp() if at is None else at, write=F.lit("progress"),
        **{n: F.col(n) for n in names},
    )


def append_events(events: DataFrame, path: str, batch: int | None = None) -> None:
    """Append writes to the event table; nothing is updated in place.

    With the number of the ``batch`` the append may be repeated: the batch has a folder of its own, which a second attempt
    replaces. A table has either numbered batches only or none.
    """
    if batch is None:
        events.write.mode("append").parquet(path)
    else:
        events.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table at ``path``, with or without numbered batches."""
    return spark.read.schema(JOB_EVENTS).parquet(path)


def finished_sessions(chunks: DataFrame) -> DataFrame:
    """Sessions to turn into jobs: those with audio that stopped, and those with audio that never sent a stop.

    One aggregation gives both; a session without audio gives no job.
    """
    audio, stop = F.col("kind") == "audio", F.col("kind") == "stop"
    return (
        chunks.groupBy("recording_id")
        .agg(F.count_if(audio).alias("n_chunks"), F.bool_or(stop).alias("stopped"))
        .filter(F.col("n_chunks") > 0)
    )


def orphan_sessions(chunks: DataFrame) -> DataFrame:
    """Sessions with audio but without a stop message."""
    return finished_sessions(chunks).filter(~F.col("stopped")).select("recording_id", "n_chunks")


def asr_quality(words: DataFrame, recordings: DataFrame, state: DataFrame) -> DataFrame:
    """Words, mean confidence and real-time factor (processing seconds per audio second) per recording."""
    counted = words.groupBy("recording_id").agg(
        F.count("*").alias("n_words"), F.avg(F.coalesce("confidence", F.lit(1.0))).alias("avg_confidence")
    )
    spent = state.select(
        F.col("job_id").alias("recording_id"),
        F.expr("timestampdiff(MILLISECOND, started_at, completed_at)").alias("processing_ms"),
    )
    return recordings.join(counted, ["recording_id"], "left").join(spent, ["recording_id"], "left").select(
        "recording_id",
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        "avg_confidence",
        "duration_ms",
        "processing_ms",
        (F.col("processing_ms") / F.col("duration_ms")).alias("rtf"),
    )


def asr_quality_totals(rows: DataFrame) -> DataFrame:
    """Totals of ``asr_quality``: one row; confidence is the mean over all words."""
    weighted = F.sum(F.col("avg_confidence") * F.col("n_words")) / F.sum("n_words")
    return rows.agg(
        F.count("*").alias("n_recordings"),
        F.sum("n_words").alias("n_words"),
        weighted.alias("avg_confidence"),
        F.sum("duration_ms").alias("duration_ms"),
        F.sum("processing_ms").alias("processing_ms"),
        (F.sum("processing_ms") / F.sum("duration_ms")).alias("rtf"),
    )
