"""One job per session that ends with audio, on a stream of chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

IDLE_MS = 60_000
FINISHED = "recording_id long, n_chunks long, reason string"
STATE = "n_chunks long, reason string, done boolean"


def _close(
    idle_ms: int | None, key: tuple, batches: Iterator[pd.DataFrame], state: Any
) -> Iterator[pd.DataFrame]:
    n, reason, done = state.get if state.exists else (0, "", False)
    if idle_ms and state.hasTimedOut:
        reason = reason or "idle"
    for rows in batches:
        n += int((rows["kind"] == "audio").sum())
        kinds = set(rows["kind"])
        reason = "stop" if "stop" in kinds else reason or ("disconnect" if "disconnect" in kinds else "")
    timed_out = bool(idle_ms) and state.hasTimedOut
    if reason and n and not done:
        done = True
        yield pd.DataFrame({"recording_id": [key[0]], "n_chunks": [n], "reason": [reason]})
    if timed_out:  # silent for the idle time after its end, or ended by it: nothing of the session stays
        state.remove()
        return
    state.update((n, reason, done))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)


def finished_sessions(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Emit a session once, when it has audio and was stopped, was disconnected or fell silent for ``idle_ms``.

    A finished session stays in the state for one idle time, so late chunks make no second job, and is then forgotten.
    Only the kind of each chunk is shuffled, and rows of a session are counted batch by batch, never gathered. A
    replay of stored chunks passes ``idle_ms=None``: a processing-time timer keeps a bounded run from ending.
    """
    return (
        chunks.select("recording_id", "kind")
        .groupBy("recording_id")
        .applyInPandasWithState(
            partial(_close, idle_ms), FINISHED, STATE, "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout"
        )
    )
