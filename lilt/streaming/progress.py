"""Job state on a stream of job events: live jobs as a small table that every batch replaces, finished ones apart.

A job's row is a partial fold: for each column its last write and when it was. Folds merge in any order, so a batch folds its
own events, merges them with the live rows and writes what results under its number. A job leaves the live rows once its
status has been final for ``KEEP_BATCHES`` batches, or once that many batches brought no write of it, so that a batch costs what
the last few batches brought and not all jobs that are still open; a write that comes later still is folded with the closed row on
reading.

The number makes a repeated batch write the same folders again. Live rows of earlier batches are retired, all but the last,
which a repeated batch reads. Closed rows of ``MERGE_BATCHES`` batches become one folder, those again one, and so on, so that
the number of folders grows with the logarithm of the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lilt.operators.jobs import folded_events, folded_rows, state_of

TERMINAL = ("complete", "failed")
KEEP_BATCHES = 4
MERGE_BATCHES = 8


def _folders(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()) if store.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _numbers(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) batch of each complete folder."""
    names = [n.split("-") for n in _folders(spark, path) if n.startswith("batches-")]
    return sorted((int(a), int(b)) for _, a, b in names)


def _folder(path: str, first: int, last: int) -> str:
    return f"{path}/batches-{first:012d}-{last:012d}"


def _merge_closed(spark: SparkSession, path: str, batch: int) -> None:
    """Put together as many folders as end a run of ``MERGE_BATCHES``, like the digits of the batch number carry over."""
    span = MERGE_BATCHES
    while (batch + 1) % span == 0:
        first = batch + 1 - span
        parts = [n for n in _numbers(spark, path) if first <= n[0] and n[1] <= batch]
        if len(parts) > 1:
            rows = spark.read.parquet(*[_folder(path, *n) for n in parts])
            folded_rows(rows).write.mode("overwrite").parquet(_folder(path, first, batch))
            for n in parts:
                if n != (first, batch):
                    _remove(spark, _folder(path, *n))
        span *= MERGE_BATCHES


def store_batch(events: DataFrame, batch: int, path: str) -> None:
    """Fold one batch of events into the tables under ``path``; doing it again changes nothing."""
    spark = events.sparkSession
    live, closed = f"{path}/live", f"{path}/closed"
    before = [n for n in _numbers(spark, live) if n[1] < batch]
    rows = folded_events(events).withColumns({"final_batch": F.lit(None).cast("long"), "last_batch": F.lit(batch).cast("long")})
    if before:
        rows = rows.unionByName(spark.read.parquet(_folder(live, *before[-1])))
    # Writes that came after their job had been closed have no status here; they follow it.
    final = F.coalesce(F.col("status.value").isin(*TERMINAL), F.lit(True))
    merged = folded_rows(rows, greatest=("last_batch",)).withColumn("final_batch", F.when(final, F.coalesce("final_batch", F.lit(batch).cast("long"))))
    done = F.coalesce(F.least("final_batch", "last_batch") <= batch - KEEP_BATCHES, F.lit(False))
    merged.where(~done).write.mode("overwrite").parquet(_folder(live, batch, batch))
    merged.where(done).write.mode("overwrite").parquet(_folder(closed, batch, batch))
    _merge_closed(spark, closed, batch)
    for n in before[:-1]:
        _remove(spark, _folder(live, *n))


def write_progress(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keep the state of the jobs of a stream of events under ``path``; ``latest`` reads it."""

    def store(rows: DataFrame, batch: int) -> None:
        store_batch(rows, batch, path)

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Current state per job; ``terminal`` tells clients to stop polling."""
    live, closed = f"{path}/live", f"{path}/closed"
    folders = [_folder(live, *n) for n in _numbers(spark, live)[-1:]] + [_folder(closed, *n) for n in _numbers(spark, closed)]
    rows = folded_rows(spark.read.parquet(*folders)).drop("final_batch", "last_batch")
    return state_of(rows).withColumn("terminal", F.col("status").isin(*TERMINAL))
