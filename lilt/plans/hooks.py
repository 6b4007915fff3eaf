"""User models inside Spark tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _loaded() -> dict[str, Any]:
    """Models of this worker process; kept in a module, as task code is unpickled anew for each task."""
    return vars(sys.modules.setdefault("lilt_loaded_models", ModuleType("lilt_loaded_models")))


def model_hook(
    items: DataFrame,
    name: str,
    load: Callable[[], Any],
    predict: Callable[[Any, pd.DataFrame], pd.DataFrame],
    keys: list[str],
    output: T.StructType,
) -> DataFrame:
    """Run a model on batches of rows: keys, then the fields of ``output``, then ``error``.

    ``load`` runs once per Python worker. ``predict`` takes a batch and gives a frame with one row for each of its rows. A
    batch that fails is halved, and four rows told apart at once, until the rows that fail stand alone, so f bad rows among n cost at
    most about 2 f log n calls. A row that fails alone keeps NULL fields and reports the error.
    """
    fields = [items.schema[k] for k in keys] + list(output.fields) + [T.StructField("error", T.StringType())]
    names = output.fieldNames()

    def told(model: Any, rows: pd.DataFrame) -> pd.DataFrame:
        found = predict(model, rows)
        if len(found) != len(rows):
            raise ValueError(f"{len(found)} predictions for {len(rows)} rows")
        return found[names].set_axis(rows.index)

    def solved(model: Any, rows: pd.DataFrame) -> pd.DataFrame:
        found, failed = [], {}
        parts = [rows]  # of unknown outcome
        while parts:
            part = parts.pop()
            try:
                found.append(told(model, part))
            except Exception as problem:  # noqa: BLE001 - reported as a column
                if len(part) == 1:
                    failed[part.index[0]] = f"{type(problem).__name__}: {problem}"
                else:
                    step = (len(part) + 1) // 2 if len(part) > 4 else 1
                    parts += [part.iloc[k : k + step] for k in range(0, len(part), step)]
        if failed:
            found.append(pd.DataFrame(None, index=list(failed), columns=names, dtype=object))
        whole = pd.concat(found).loc[rows.index]
        return whole.assign(error=pd.Series(failed, dtype=object).reindex(rows.index) if failed else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = _loaded()
        if name not in models:
            models[name] = load()
        model = models[name]
        for rows in batches:
            if not len(rows):
                continue
            yield pd.concat([rows[keys], solved(model, rows)], axis=1)

    return items.mapInPandas(run, T.StructType(fields))
