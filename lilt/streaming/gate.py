"""When a live preview runs: every second chunk may start a run, and a run needs enough new audio.

New audio counts from the last word that was given out. A run gives out words up to ``GUARD_MS`` before the end of its audio, so
the next run is the first allowed chunk whose audio ends ``LEAST_NEW_MS`` after that point: each firing depends on the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lilt.operators.chain import bounded_spans
from lilt.operators.scan import Run, running
from lilt.streaming.live import CHUNK_STEP, GUARD_MS, IDLE_MS, LEAST_NEW_MS

#: Span of audio whose checks are folded together in the batch version.
BLOCK_MS = 1 << 22
#: A missing chunk of a live session is given up once so many later ones are here.
WAIT_CHUNKS = 8

FIRED = "recording_id long, seq long, n_chunks long, audio_end_ms long"
_NO_PAUSE = 1 << 60


def trigger_gate(chunks: DataFrame, step: int = CHUNK_STEP, least_ms: int = LEAST_NEW_MS, guard_ms: int = GUARD_MS) -> DataFrame:
    """Chunks that start a preview run, from ``chunks(recording_id, seq, kind, audio_ms)`` with a dense ``seq``.

    Only every ``step``-th chunk after the first one is looked at. The chain of firings is the one of greedy spans: a run opens
    a span at the end of its audio, and the first chunk beyond the span's reach opens the next. Blocks of audio become maps
    from the open span to the one left open, so a recording of any length is solved block by block.
    """
    heard = running(
        chunks.where("kind = 'audio'").select("recording_id", "seq", "audio_ms"), ["recording_id"], "seq",
        {"audio_end_ms": Run("sum", F.col("audio_ms"))},
    )
    count = F.col("seq") + 1
    looked = heard.where((count > 1) & ((count - 1) % step == 0) & (F.col("audio_end_ms") >= least_ms))
    spans = looked.select(
        "recording_id", F.col("audio_end_ms").alias("start_sample"), F.col("audio_end_ms").alias("end_sample"),
        F.col("seq").alias("seg_idx"), F.lit(0).cast("long").alias("part"),
    )
    reach = least_ms - guard_ms
    # Checks without audio of their own share an end; only the first of them can open a span.
    opened = bounded_spans(spans, _NO_PAUSE, reach - 1, max(BLOCK_MS, 4 * reach))
    firsts = opened.where("group_start = start_sample").groupBy("recording_id", F.col("start_sample").alias("audio_end_ms"))
    return firsts.agg(F.min("seg_idx").alias("seq")).select(
        "recording_id", "seq", (F.col("seq") + 1).alias("n_chunks"), "audio_end_ms"
    )


def firings(ends: np.ndarray, given: float, least_ms: int, guard_ms: int) -> tuple[np.ndarray, float]:
    """Places of the checks that fire, by binary search from one to the next, and the point up to which words are out."""
    out = []
    at = int(np.searchsorted(ends, given + least_ms))
    while at < len(ends):
        out.append(at)
        given = int(ends[at]) - guard_ms
        at = max(at + 1, int(np.searchsorted(ends, given + least_ms)))
    return np.array(out, dtype=np.int64), given


class TriggerGate(StatefulProcessor):
    """Firings of one session; chunks ahead of a missing one wait in a map."""

    def __init__(self, step: int, least_ms: int, guard_ms: int, idle_ms: int | None, wait: float):
        self.step, self.least_ms, self.guard_ms, self.idle_ms, self.wait = step, least_ms, guard_ms, idle_ms, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "next_seq long, audio_end_ms long, given_ms long")
        self.ahead = handle.getMapState("ahead", "seq long", "audio_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.position.exists()
        following, total, given = self.position.get() if known else (0, 0, 0)
        stored = {int(k[0]): int(v[0]) for k, v in self.ahead.iterator()} if known else {}
        held = dict(stored)
        for part in rows:
            part = part[(part["kind"] == "audio").to_numpy()]
            fresh = part[part["seq"].to_numpy() >= following]
            held.update(zip(fresh["seq"].astype("int64").tolist(), fresh["audio_ms"].fillna(0).astype("int64").tolist()))
        order = np.array(sorted(held), dtype=np.int64)
        # Everything up to the first hole, and beyond it once enough chunks are behind the hole.
        gaps = np.flatnonzero(np.diff(np.concatenate(([following - 1], order))) > 1)
        ready = len(order)
        for gap in gaps.tolist():
            if order[-1] - following < self.wait:
                ready = gap
                break
        taken = order[:ready]
        if len(taken):
            ends = total + np.cumsum([held[k] for k in taken.tolist()])
            looked = np.flatnonzero((taken > 0) & (taken % self.step == 0))
            fired, given = firings(ends[looked], given, self.least_ms, self.guard_ms)
            at = looked[fired]
            following, total = int(taken[-1]) + 1, int(ends[-1])
            if len(at):
                yield pd.DataFrame({"recording_id": key[0], "seq": taken[at], "n_chunks": taken[at] + 1, "audio_end_ms": ends[at]})
        for seq in stored:
            if seq < following:
                self.ahead.removeKey((seq,))
        for seq, ms in held.items():
            if seq >= following and stored.get(seq) != ms:
                self.ahead.updateValue((seq,), (ms,))
        self.position.update((following, total, int(given)))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.position.clear()
        self.ahead.clear()
        return iter([])

    def close(self) -> None:
        pass


def gate_stream(
    chunks: DataFrame, step: int = CHUNK_STEP, least_ms: int = LEAST_NEW_MS, guard_ms: int = GUARD_MS,
    idle_ms: int | None = IDLE_MS, wait: float = WAIT_CHUNKS,
) -> DataFrame:
    """``trigger_gate`` on a stream, append mode. A replay of stored chunks passes ``idle_ms=None`` and ``wait=live.NO_END``."""
    gate = TriggerGate(step, least_ms, guard_ms, idle_ms, wait)
    rows = chunks.select("recording_id", "seq", "kind", "audio_ms")
    return rows.groupBy("recording_id").transformWithStateInPandas(gate, FIRED, "append", "processingTime" if idle_ms else "none")

