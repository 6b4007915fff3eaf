"""Live words from overlapping recogniser windows.

Windows of a session overlap by six seconds. A cursor per session marks what has been emitted; each window adds the
words that start at or after the cursor and end at least 0.4 s before the live edge.

The stream carries single rows: a word once, with the first and last window that hold it, and one row per window. A
stateful processor keeps the position of a session, the windows that wait for their turn and the words that a later window
still holds; timers end idle sessions.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lilt.functions.tokens import clean_token_weak
from lilt.operators.scan import attach, block_of, text_pieces

# Fixed values, in milliseconds: guard before the edge, least new audio, longest silent lag and where it resumes.
GUARD_MS = 400
LEAST_NEW_MS = 1500
LAG_MS = 5000
RESUME_MS = 2000
CHUNK_STEP = 2
# A window that is ahead of its turn, or lacks words, waits until this many windows have come after the missing one.
WAIT_WINDOWS = 4
# For stored windows, of which none can still be missing.
NO_END = math.inf
# A session without events for this long gives out what waits and is forgotten.
IDLE_MS = 60_000

#: Keys that the sessions share.
BUCKETS = 1024

#: Rows of a live session. A window has ``n_words``, its number as ``first_seq`` and ``last_seq``, its span as times; all
#: other rows are words, with times on the session's axis. ``after`` names the window before, where that is known.
LIVE_EVENTS = (
    "session_id long, first_seq long, last_seq long, word_idx long, word string, start_ms long, end_ms long,"
    " confidence double, n_words int, after long"
)
_WORD_STATE = "first_seq long, last_seq long, word_idx long, word string, start_ms long, end_ms long, confidence double"
_WINDOW_STATE = "start_ms long, end_ms long, n_words long, after long"
_LISTS = (
    "session_id long, trigger_seq long, window_start_ms long,"
    " word array<string>, start_ms array<long>, end_ms array<long>, confidence array<double>"
)
WORD = ("word", "start_ms", "end_ms", "confidence")


@dataclass
class Words:
    """Words of a session as columns, each once, in order of start."""

    first: list[int]
    last: list[int]
    index: list[int]
    word: list[str]
    start: list[int]
    end: list[int]
    confidence: list[float]

    @classmethod
    def of(cls, columns: list[np.ndarray]) -> Words:
        """A row that came twice (same windows, same index) counts once."""
        first, last, index, _, start = columns[:5]
        order = np.lexsort((last, first, index, start))
        if len(order) > 1:
            fresh = np.ones(len(order), dtype=bool)
            a, b = order[1:], order[:-1]
            fresh[1:] = (first[a] != first[b]) | (last[a] != last[b]) | (index[a] != index[b])
            order = order[fresh]
        return cls(*[c[order].tolist() for c in columns])

    def held_after(self, following: int) -> list[tuple]:
        """Rows of words that a window from ``following`` on holds."""
        rows = zip(self.first, self.last, self.index, self.word, self.start, self.end, self.confidence)
        return [(*r[:-1], None if r[-1] != r[-1] else r[-1]) for r in rows if r[1] >= following]


def advance(cursor: int, seq: int, edge: int, words: Words) -> tuple[int, list[int]]:
    """Places of the words that one window emits, and the new cursor."""
    if edge - cursor < LEAST_NEW_MS:
        return cursor, []
    first, last, end, safe = words.first, words.last, words.end, edge - GUARD_MS
    fresh = [
        k
        for k in range(bisect_left(words.start, cursor), bisect_right(words.start, edge))
        if end[k] <= safe and first[k] <= seq <= last[k]
    ]
    if fresh:
        fresh.sort(key=words.index.__getitem__)
        return end[fresh[-1]], fresh
    return (edge - RESUME_MS if edge - cursor > LAG_MS else cursor), fresh


def walk(following: int, cursor: int, windows: dict[int, tuple], words: Words, wait: float) -> tuple[int, int, list[tuple[int, int, list[int]]]]:
    """Windows (number to start, end, count of words, window before) in order, over gaps; taken ones leave the dictionary.

    A window has its turn when the one before it had its own and all its words are here. It goes on without them once a
    window ``wait`` places later is here. A window that names the one before it needs no other number to come first.
    """
    order = sorted(windows)
    here = np.searchsorted(np.sort(words.first), order, "right") - np.searchsorted(np.sort(words.last), order, "left")
    out = []
    for seq, present in zip(order, here.tolist()):
        start, edge, count, after = windows[seq]
        turn = seq <= following or (after is not None and after < following)
        if not (turn and present >= count) and order[-1] - following < wait:
            break
        del windows[seq]
        cursor, fresh = advance(cursor, seq, edge, words)
        if fresh:
            out.append((seq, start, fresh))
        following = seq + 1
    return following, cursor, out


_SPOKEN = ("first_seq", "last_seq", "word_idx", "word", "start_ms", "end_ms", "confidence")
_KINDS = (np.int64, np.int64, np.int64, object, np.int64, np.int64, np.float64)


def _slices(sessions: np.ndarray) -> tuple[np.ndarray, dict[int, slice]]:
    """Order of rows by session, and the place of each session in it."""
    order = np.argsort(sessions, kind="stable")
    names, begin = np.unique(sessions[order], return_index=True)
    return order, {n: slice(a, b) for n, a, b in zip(names.tolist(), begin.tolist(), [*begin.tolist()[1:], len(order)])}


class LiveWords(StatefulProcessor):
    """Emitted words per window, for the sessions of one bucket at a time.

    Calls per key and calls to the state store cost far more than a window, and most sessions are short; so sessions share
    a key. Each has its own position; windows and words that wait are kept with their session.
    """

    def __init__(self, idle_ms: int | None, wait: float):
        self.idle_ms, self.wait = idle_ms, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.positions = handle.getMapState("positions", "session_id long", "next_seq long, cursor_ms long, seen_ms long")
        self.windows = handle.getMapState("windows", "session_id long, trigger_seq long", _WINDOW_STATE)
        self.words = handle.getListState("words", f"session_id long, {_WORD_STATE}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts = list(rows)
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        opens = rows["n_words"].notna().to_numpy()
        sessions = rows["session_id"].to_numpy(dtype=np.int64)
        spoken, opened = np.flatnonzero(~opens), np.flatnonzero(opens)
        columns = [rows[c].to_numpy()[spoken].astype(kind, copy=False) for c, kind in zip(_SPOKEN, _KINDS)]
        bounds = [rows[c].to_numpy()[opened].astype(np.int64).tolist() for c in ("first_seq", "start_ms", "end_ms", "n_words")]
        after = [None if a != a else int(a) for a in rows["after"].to_numpy(dtype=np.float64)[opened].tolist()]
        word_order, word_places = _slices(sessions[spoken])
        columns = [c[word_order] for c in columns]
        window_order, window_places = _slices(sessions[opened])
        window_order = window_order.tolist()

        held_words: dict[int, list[tuple]] = {}
        for session, *word in self.words.get() if self.words.exists() else ():
            held_words.setdefault(session, []).append(tuple(word))
        held_windows: dict[int, dict[int, tuple]] = {}
        for (session, seq), window in self.windows.iterator() if self.windows.exists() else ():
            held_windows.setdefault(session, {})[seq] = tuple(window)
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        out = []
        for session in sorted(set(word_places) | set(window_places)):
            following, cursor, _ = self.positions.getValue((session,)) or (1, 0, 0)
            stored = held_windows.get(session, {})
            windows = dict(stored)
            for k in window_order[window_places.get(session, slice(0, 0))]:
                seq, start, edge, count = (column[k] for column in bounds)
                before = after[k]
                if seq >= following:
                    if seq in windows and before is not None and windows[seq][3] is not None:
                        before = min(before, windows[seq][3])  # a repeated window follows the one before its first row
                    windows[seq] = (start, edge, count, before)
            at = word_places.get(session, slice(0, 0))
            mine = [c[at] for c in columns]
            if session in held_words:
                old = zip(*held_words.pop(session))
                mine = [np.concatenate((np.array(list(o), dtype=kind), m)) for o, m, kind in zip(old, mine, _KINDS)]
            words = Words.of(mine)
            following, cursor, taken = walk(following, cursor, windows, words, self.wait)
            for seq in stored:
                if seq not in windows:
                    self.windows.removeKey((session, seq))
            for seq, window in windows.items():
                if stored.get(seq) != window:
                    self.windows.updateValue((session, seq), window)
            left = words.held_after(following)
            if left:
                held_words[session] = left
            self.positions.updateValue((session,), (following, cursor, now))
            out.append((session, taken, words))
        self._keep(held_words)
        if self.idle_ms and not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.idle_ms)
        yield from _emitted(out)

    def _keep(self, words: dict[int, list[tuple]]) -> None:
        rows = [(session, *w) for session, held in words.items() for w in held]
        if rows:
            self.words.put(rows)
        elif self.words.exists():
            self.words.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Sessions of the bucket that were silent for the idle time give out what waits and leave the state."""
        now = timerValues.getCurrentProcessingTimeInMs()
        positions = {k[0]: tuple(v) for k, v in self.positions.iterator()}
        silent = {session for session, (_, _, seen) in positions.items() if seen + self.idle_ms <= now}
        held_words: dict[int, list[tuple]] = {}
        for session, *word in self.words.get() if self.words.exists() else ():
            held_words.setdefault(session, []).append(tuple(word))
        held_windows: dict[int, dict[int, tuple]] = {}
        for (session, seq), window in self.windows.iterator() if self.windows.exists() else ():
            held_windows.setdefault(session, {})[seq] = tuple(window)
        out = []
        for session in sorted(silent):
            following, cursor, _ = positions[session]
            windows = held_windows.get(session, {})
            for seq in windows:
                self.windows.removeKey((session, seq))
            columns = zip(*held_words.pop(session)) if session in held_words else [()] * len(_KINDS)
            words = Words.of([np.array(list(c), dtype=kind) for c, kind in zip(columns, _KINDS)])
            out.append((session, walk(following, cursor, dict(windows), words, 0)[2], words))
            self.positions.removeKey((session,))
        self._keep(held_words)
        awake = [seen for session, (_, _, seen) in positions.items() if session not in silent]
        if awake:
            self.handle.registerTimer(min(awake) + self.idle_ms)
        yield from _emitted(out)

    def close(self) -> None:
        pass


def _emitted(out: list[tuple[int, list[tuple[int, int, list[int]]], Words]]) -> Iterator[pd.DataFrame]:
    rows = [
        (session, seq, start, *([column[k] for k in at] for column in (words.word, words.start, words.end, words.confidence)))
        for session, taken, words in out
        for seq, start, at in taken
    ]
    if rows:
        yield pd.DataFrame(rows, columns=["session_id", "trigger_seq", "window_start_ms", *WORD])


def window_events(windows: DataFrame) -> DataFrame:
    """Rows of ``LIVE_EVENTS`` from windows with their words as an array, times from the window's start; on streams and tables."""
    after = F.col("after") if "after" in windows.columns else F.lit(None)
    none = F.lit(None)
    start = F.col("window_start_ms")
    words = F.transform(
        "words",
        lambda w, i: F.struct(
            i.cast("long").alias("word_idx"), w["word"].alias("word"), (w["start_ms"] + start).alias("start_ms"),
            (w["end_ms"] + start).alias("end_ms"), w["confidence"].cast("double").alias("confidence"), none.cast("int").alias("n_words"),
        ),
    )
    window = F.struct(
        none.cast("long").alias("word_idx"), none.cast("string").alias("word"), start.alias("start_ms"), (start + F.col("window_len_ms")).alias("end_ms"),
        none.cast("double").alias("confidence"), F.size("words").alias("n_words"),
    )
    return windows.select(
        "session_id", F.col("trigger_seq").alias("first_seq"), F.col("trigger_seq").alias("last_seq"),
        F.explode(F.concat(words, F.array(window))).alias("e"), after.cast("long").alias("after"),
    ).select("session_id", "first_seq", "last_seq", "e.*", "after")


def live_words(events: DataFrame, idle_ms: int | None = IDLE_MS, wait: float = WAIT_WINDOWS, buckets: int = BUCKETS) -> DataFrame:
    """Emitted words per trigger, append mode; one row per trigger that adds words. ``events`` as in ``LIVE_EVENTS``.

    Windows that arrive ahead of their turn or of their words wait in the state, ``WAIT_WINDOWS`` at most, so results do
    not depend on file or partition order. A window that was left out, or a stream joined later, holds nothing up beyond
    that: the cursor goes on with the windows that are there, and what comes later for a given-up place is dropped. Idle
    sessions give out what waits and leave the state. A replay of stored windows passes ``idle_ms=None``: a timer keeps a
    bounded run from ending. Its windows are all there, so it gives none up (``wait=NO_END``), in whatever order the files
    are read: ``after`` names the stored window before each (0 for the first), which takes the cursor over real gaps.
    Sessions are dealt to ``buckets`` keys; have several for each core, and keep the number over a stream's restarts.
    State stores must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    mode = "processingTime" if idle_ms else "none"
    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    lists = dealt.groupBy("bucket").transformWithStateInPandas(LiveWords(idle_ms, wait), _LISTS, "append", mode)
    word = F.transform(
        F.arrays_zip(*WORD),
        lambda w: F.struct(*[(F.when(~F.isnan(w[c]), w[c]) if c == "confidence" else w[c]).alias(c) for c in WORD]),
    )
    return lists.select("session_id", "trigger_seq", "window_start_ms", word.alias("words"))


def flat_words(emitted: DataFrame) -> DataFrame:
    return emitted.select(
        "session_id", "trigger_seq", "window_start_ms", F.posexplode("words").alias("pos", "w")
    ).select("session_id", "trigger_seq", "window_start_ms", "pos", "w.*")


def messages(emitted: DataFrame) -> DataFrame:
    """JSON message per trigger for display clients; works on streams and tables."""
    text = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    body = F.struct(
        F.lit("incremental_words").alias("type"), F.lit(False).alias("replace_words"), "words", text.alias("text")
    )
    return emitted.select("session_id", "trigger_seq", F.to_json(body).alias("message"))


def write_messages(emitted: DataFrame, path: str, checkpoint: str):
    """Append the messages of a stream to a parquet folder."""
    return (
        messages(emitted).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )


def preview_text(emitted: DataFrame, replace: Column | None = None) -> DataFrame:
    """Running preview per session as pieces, from the last replacing trigger on: the text of each trigger that adds
    words, its character ``offset`` in the joined text, and ``total_chars`` of that text. No row grows with the session.
    """
    text = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    rows = emitted.select("session_id", "trigger_seq", text.alias("text"), F.size("words").cast("bigint").alias("n_words"),
                          (replace if replace is not None else F.lit(False)).alias("_replaces"))
    if replace is not None:
        last = rows.groupBy("session_id").agg(F.max(F.when(F.col("_replaces"), F.col("trigger_seq"))).alias("_from"))
        rows = attach(rows, last, ["session_id"], block_of("trigger_seq", 4096)).filter(
            F.col("_from").isNull() | (F.col("trigger_seq") >= F.col("_from"))
        ).drop("_from")
    return text_pieces(rows.drop("_replaces"), ["session_id"], "trigger_seq")


def sliding_windows(
    words: DataFrame, last: DataFrame, window_ms: int = 8000, slide_ms: int = 2000
) -> DataFrame:
    """Words per window ending at each live edge, counted with map-side partial sums.

    ``last(recording_id, last_trigger)``: the live edge never passes the end of the audio.
    """
    reach = F.expr(
        f"sequence(greatest(1, (end_ms + {slide_ms - 1}) div {slide_ms}), (start_ms + {window_ms}) div {slide_ms})"
    )
    fits = F.expr(f"(end_ms + {slide_ms - 1}) div {slide_ms} <= (start_ms + {window_ms}) div {slide_ms}")
    counted = (
        words.filter(fits)
        .withColumn("trigger_seq", F.explode(reach))
        .groupBy("recording_id", "trigger_seq")
        .agg(F.count("*").alias("n_words"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))
    )
    bounded = attach(counted, last, ["recording_id"], block_of("trigger_seq"), "inner")
    return bounded.filter(F.col("trigger_seq") <= F.col("last_trigger")).drop("last_trigger")


def window_stress(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """Stress labels onto the words of each window, ahead of deduplication.

    ``windows(session_id, trigger_seq, words)``, ``labels(session_id, trigger_seq, labels ARRAY<STRUCT<word, label>>)``.
    A window is bounded, so matching stays inside the row: same position by prefix, else the first equal text.
    """
    cleaned = F.transform(
        "labels",
        lambda x: F.struct(clean_token_weak(x["word"]).alias("t"), (x["label"] == 1).alias("stressed")),
    )
    joined = windows.join(labels, ["session_id", "trigger_seq"], "left").withColumn("_l", cleaned)

    def find(w, i):
        token = clean_token_weak(w["word"])
        here = F.get(F.col("_l"), i)
        near = token.startswith(here["t"]) | here["t"].startswith(token)
        first = F.get(F.filter("_l", lambda x: x["t"] == token), F.lit(0))
        stressed = F.coalesce(F.when(near, here["stressed"]).otherwise(first["stressed"]), F.lit(False))
        return F.struct(
            w["word"].alias("word"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"),
            w["confidence"].alias("confidence"), stressed.alias("stressed"),
        )

    return joined.withColumn("words", F.transform("words", find)).drop("_l", "labels")


def utterance_stream(words: DataFrame, gap_ms: int = 1200, delay: str = "8 seconds") -> DataFrame:
    """Utterances of a stream of words with ``start_ts`` and ``end_ts``: closed by a silence of ``gap_ms``.

    The session gap of a word is its own duration plus the silence, so a word joins when it starts before the silence
    after the latest word is over. Session windows also merge when they just touch, hence one microsecond less.
    """
    length = F.unix_micros("end_ts") - F.unix_micros("start_ts") + (gap_ms * 1000 - 1)
    gap = F.concat(length.cast("string"), F.lit(" microseconds"))
    return (
        words.withWatermark("start_ts", delay)
        .groupBy("recording_id", F.session_window("start_ts", gap))
        .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n_words"))
        .drop("session_window")
    )
