"""End-to-end analysis of many recordings in one plan."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lilt.operators import pauses, stylize, summary, voicing, word_pitch
from lilt.operators.phrases import phrase_words
from lilt.operators.stress import align_stress, normalize_labels
from lilt.plans.registry import KEY, RECORDING, Analyzer, Registry
from lilt.session import cut

def _stress(words: DataFrame, tables: Mapping[str, Any]) -> DataFrame:
    aligned = align_stress(words.select(*KEY, "phrase_index", "pos", "word"), normalize_labels(tables["stress_labels"]))
    return aligned.select(*KEY, "stressed", "stress_score")


def _pitch(words: DataFrame, tables: Mapping[str, Any]) -> DataFrame:
    features = pitch_features(words, tables["pitch_frames"], tables.get("criterion", "mae"))
    return features.drop("word", "start_ms", "end_ms")


def _intonation(words: DataFrame, tables: Mapping[str, Any]) -> DataFrame:
    tones = word_pitch.word_intonation(words, tables["intonation_frames"])
    return tones.drop("phrase_index", "pos", "word", "start_ms", "end_ms")


def pitch_features(words: DataFrame, frames: DataFrame, criterion: str = "mae") -> DataFrame:
    """Cleaned runs, segments, stylised contour, and features per word."""
    segments = voicing.voiced_segments(frames)
    styled = stylize.stylize_segments(stylize.with_piece_count(segments), criterion)
    return word_pitch.word_pitch_features(words, stylize.full_contour(frames, styled), segments)


def default_registry(pitch: bool = False, intonation: bool = False) -> Registry:
    """Stress always; intonation and pitch when their frame tables are given."""
    registry = Registry().add(Analyzer("stress", _stress, defaults={"stressed": False, "stress_score": 0.0}, needs=("stress_labels",)))
    if intonation:
        registry.add(Analyzer("intonation", _intonation, defaults={"pitch_mean": None, "pitch_direction": None}, needs=("intonation_frames",)))
    if pitch:
        registry.add(Analyzer("pitch", _pitch, scope=RECORDING, defaults={"mean_pitch": None}, needs=("pitch_frames",)))
    return registry


def analyze(words: DataFrame, tables: Mapping[str, Any], registry: Registry | None = None) -> DataFrame:
    """Feature row per word: phrase, position, pause, hesitation, and what the analyzers add."""
    return (registry or default_registry()).apply(cut(phrase_words(words), "phrased"), tables)


def session_overview(featured: DataFrame, recordings: DataFrame) -> DataFrame:
    """Per recording: words, speed, stress ratio, pauses, hesitations, and confidence after absorption."""
    featured = cut(featured, "featured")
    rollup = summary.session_summary(featured, recordings, with_pauses=True)
    confidence = pauses.average_confidence(pauses.absorb_hesitations(featured))
    return (
        rollup.join(confidence, ["recording_id"], "left")
        .fillna(0, ["avg_confidence_pct"])
        .withColumn("wpm", F.round("wpm", 6))
    )
