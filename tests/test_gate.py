"""The gate of live previews: batch and stream against a plain loop."""

import random

import numpy as np
import pandas as pd
import pytest

from lilt.plans import streams
from lilt.streaming import gate, live
from test_streaming import Handle

SF = "/root/testdata/sf0.01"


def fold(durations, step=2, least=1500, guard=400):
    out, total, given = [], 0, 0
    for seq, ms in enumerate(durations):
        total += ms
        if seq and seq % step == 0 and total - given >= least:
            out.append((seq, total))
            given = total - guard
    return out


def sessions(seed):
    draw = random.Random(seed)
    long = [draw.choice([0, 40, 300, 700]) for _ in range(400)]
    return {1: long, 2: [2000] * 9, 3: [], 4: [10] * 5, 5: [0] * 30 + [1500, 0, 0, 1100, 0, 1099, 1, 0], 6: [750] * 12}


@pytest.mark.parametrize("block", [gate.BLOCK_MS, 5000])
def test_batch(spark, monkeypatch, block):
    monkeypatch.setattr(gate, "BLOCK_MS", block)
    rows = [(k, s, "audio", ms) for k, v in sessions(1).items() for s, ms in enumerate(v)] + [(2, 9, "stop", None), (7, 0, "stop", None)]
    random.Random(2).shuffle(rows)
    chunks = spark.createDataFrame(rows, "recording_id long, seq long, kind string, audio_ms long").repartition(3)
    got = sorted((r.recording_id, r.seq, r.audio_end_ms) for r in gate.trigger_gate(chunks).collect())
    assert got == sorted((k, s, e) for k, v in sessions(1).items() for s, e in fold(v))


def test_firings_jump():
    draw = np.random.default_rng(3)
    for _ in range(50):
        ends = np.cumsum(draw.integers(0, 900, size=60))
        want, given = [], 100
        for k, e in enumerate(ends.tolist()):
            if e - given >= 1500:
                want.append(k)
                given = e - 400
        got, last = gate.firings(ends, 100, 1500, 400)
        assert got.tolist() == want and last == given


@pytest.mark.parametrize("batch", [1, 5, 1000])
def test_stream_in_any_order(batch):
    for seed in range(6):
        durations = sessions(seed)[1][:120]
        rows = [(s, "audio", ms) for s, ms in enumerate(durations)] + [(120, "stop", None)]
        random.Random(seed).shuffle(rows)
        made, handle = gate.TriggerGate(2, 1500, 400, None, live.NO_END), Handle()
        made.init(handle)
        got = []
        for k in range(0, len(rows), batch):
            part = pd.DataFrame(rows[k : k + batch], columns=["seq", "kind", "audio_ms"])
            for out in made.handleInputRows((1,), iter([part]), handle):
                got += list(zip(out["seq"].tolist(), out["audio_end_ms"].tolist()))
        assert got == fold(durations) and not handle.kept["ahead"].map


def test_a_missing_chunk_is_given_up_and_idle_sessions_go():
    made, handle = gate.TriggerGate(2, 1500, 400, 500, 4), Handle()
    made.init(handle)
    feed = lambda *seqs: [s for out in made.handleInputRows((1,), iter([pd.DataFrame({"seq": list(seqs), "kind": "audio", "audio_ms": 1000})]), handle) for s in out["seq"]]
    assert feed(0, 1, 2) == [2] and feed(4, 5) == [] and len(handle.kept["ahead"].map) == 2
    assert feed(6, 7) == [6] and handle.timers == [1500]
    assert list(made.handleExpiredTimer((1,), handle, None)) == [] and not handle.kept["position"].exists()


def test_stream_equals_batch(spark):
    from lilt import fixtures as fx

    batch = gate.trigger_gate(fx.audio_chunks(spark, SF)).collect()
    assert batch and sorted(map(tuple, batch)) == sorted(map(tuple, streams.gate_table(spark, SF, 1).collect()))
