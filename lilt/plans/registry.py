"""Analyzers as named transforms, in order, per phrase or per recording."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

PHRASE, RECORDING = "phrase", "recording"
KEY = ["recording_id", "word_idx"]


@dataclass(frozen=True)
class Analyzer:
    """``analyze(words, tables)`` returns a side table: the word key and the columns it adds.

    ``needs`` names the tables it reads. ``defaults`` holds for words without a row in the side table, and for all words
    when a needed table isn't given.
    """

    name: str
    analyze: Callable[[DataFrame, Mapping[str, Any]], DataFrame]
    scope: str = PHRASE
    defaults: Mapping[str, Any] = field(default_factory=dict)
    needs: tuple[str, ...] = ()


class Registry:
    """Ordered analyzers. One whose tables aren't given is skipped and its columns take their defaults; errors of an
    analyzer that runs are raised, never turned into missing values."""

    def __init__(self) -> None:
        self._known: list[Analyzer] = []

    def add(self, analyzer: Analyzer) -> Registry:
        self._known.append(analyzer)
        return self

    def names(self, scope: str | None = None) -> list[str]:
        return [a.name for a in self._known if scope in (None, a.scope)]

    @staticmethod
    def missing(analyzer: Analyzer, tables: Mapping[str, Any]) -> list[str]:
        return [n for n in analyzer.needs if tables.get(n) is None]

    def skipped(self, tables: Mapping[str, Any]) -> list[str]:
        """Names of the analyzers that ``apply`` would skip."""
        return [a.name for a in self._known if self.missing(a, tables)]

    def apply(self, words: DataFrame, tables: Mapping[str, Any]) -> DataFrame:
        """Phrase analyzers first, then those that need the whole recording.

        Every analyzer reads the given words, best a stored table, not the output of the one before; the side tables
        all join on the same key, so the words keep their partitioning from join to join.
        """
        out = words
        for scope in (PHRASE, RECORDING):
            for analyzer in (a for a in self._known if a.scope == scope):
                out = self._join(out, words, analyzer, tables)
        return out

    def _join(self, out: DataFrame, words: DataFrame, analyzer: Analyzer, tables: Mapping[str, Any]) -> DataFrame:
        absent = self.missing(analyzer, tables)
        if absent:
            log.warning("analyzer %s skipped: no table %s", analyzer.name, ", ".join(absent))
            return out.withColumns({c: F.lit(v) for c, v in analyzer.defaults.items()})
        side = analyzer.analyze(words, tables)
        joined = out.join(side, KEY, "left")
        filled = {c: F.coalesce(c, F.lit(v)) for c, v in analyzer.defaults.items() if v is not None}
        return joined.withColumns(filled) if filled else joined
