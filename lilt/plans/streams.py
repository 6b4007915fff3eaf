"""Streaming jobs run to completion over staged tables, and the tables they write."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lilt import fixtures as fx
from lilt.operators import jobs
from lilt.session import settings, shared_dir
from lilt.streaming import finalize, gate, live, progress

_DONE: dict[tuple[str, str, str], str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lilt-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: State with lists, maps and timers lives in RocksDB; a commit then writes changes, not whole states.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
BATCH_BYTES = 64 << 20


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own settings come back afterwards."""
    with settings(spark, STATE_STORE):
        yield


def _finish(writer: DataStreamWriter) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", BATCH_BYTES)
    return reader.option(*limit).parquet(path)


def _to_parquet(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = _folder(spark, name)
    sink = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    _finish(sink.option("checkpointLocation", _folder(spark, f"{name}-state")))
    return path


def live_words_table(spark: SparkSession, d: str, files_per_batch: int | None = None) -> DataFrame:
    """Replay of the live words and windows through the deduplicating stream, once per application and source.

    The files hold whole sessions but at their borders, so that few windows wait; results don't depend on it."""
    key = (spark.sparkContext.applicationId, d, "live")
    if key not in _DONE:
        source = _source(spark, fx.live_events_path(spark, d), files_per_batch)
        with state_store(spark):
            _DONE[key] = _to_parquet(spark, live.live_words(source, idle_ms=None, wait=live.NO_END), "live-words")
    return spark.read.parquet(_DONE[key])


def live_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the stream of emitted words."""
    live_words_table(spark, d)
    emitted = _source(spark, _DONE[(spark.sparkContext.applicationId, d, "live")])
    path = _folder(spark, "messages")
    _finish(live.write_messages(emitted, path, _folder(spark, "messages-state")))
    return spark.read.parquet(path)


def finished_sessions_table(spark: SparkSession, d: str) -> DataFrame:
    rows = finalize.finished_sessions(_source(spark, fx.audio_chunks_path(spark, d)), idle_ms=None)
    return spark.read.parquet(_to_parquet(spark, rows, "finished"))


def gate_table(spark: SparkSession, d: str, files_per_batch: int | None = None) -> DataFrame:
    """Preview runs of the stored chunks, found by the stream."""
    source = _source(spark, fx.audio_chunks_path(spark, d), files_per_batch)
    with state_store(spark):
        return spark.read.parquet(_to_parquet(spark, gate.gate_stream(source, idle_ms=None, wait=live.NO_END), "gate"))


def progress_table(spark: SparkSession, d: str, files_per_batch: int | None = None) -> DataFrame:
    source = _source(spark, fx.job_events_path(spark, d), files_per_batch)
    path = _folder(spark, "progress")
    _finish(progress.write_progress(source, path, _folder(spark, "progress-state")))
    return progress.latest(spark, path)


def appended_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The event table written in numbered batches, one of them twice, and folded: queued jobs get a worker's first write."""
    path = _folder(spark, "events")
    jobs.append_events(fx.job_events(spark, d), path, batch=0)
    queued = jobs.job_state(jobs.read_events(spark, path)).where("status = 'queued'").withColumn("seq", F.lit(1))
    begun = jobs.status_events(
        queued, "processing", at=F.col("created_at") + F.expr("INTERVAL '1' DAY"), total_chunks=F.col("job_id") % 7 + 1
    )
    for _ in range(2):  # as a worker would that does not know whether its first attempt came through
        jobs.append_events(begun, path, batch=1)
    return jobs.job_state(jobs.read_events(spark, path))


def window_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Live windows, and stress labels for their words with some texts changed or missing."""
    windows = fx.live_windows(spark, d)
    keyed = fx.words(spark, d).select(F.col("recording_id").alias("session_id"), "word_idx", "word", "start_ms", "end_ms")
    spread = keyed.filter("(end_ms + 1999) div 2000 <= (start_ms + 8000) div 2000").withColumn(
        "trigger_seq", F.explode(F.expr("sequence(greatest(1, (end_ms + 1999) div 2000), (start_ms + 8000) div 2000)"))
    )
    i, word = F.col("word_idx"), F.col("word")
    label = F.struct(
        "word_idx",
        F.when(i % 41 == 0, "").when(i % 7 == 0, F.concat(F.lit("zz"), word)).otherwise(word).alias("word"),
        F.when((F.length(word) + i) % 4 == 0, 1).otherwise(0).alias("label"),
    )
    labels = (
        spread.filter(i % 23 != 0)
        .groupBy("session_id", "trigger_seq")
        .agg(F.array_sort(F.collect_list(label)).alias("labels"))
    )
    return windows, labels
