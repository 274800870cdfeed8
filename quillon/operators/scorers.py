"""Scorers that are plugged in by name: any model that takes a list of texts and gives a number or None for each.

A scorer is an object with ``score(texts) -> list``; what makes one is registered
as ``module:callable``, so that workers import it instead of being sent a model.
A worker makes it once, for all its tasks of the session, and gives it batches.
A batch that raises has no scores; the heuristic stands for them
(:func:`quillon.operators.text.blended`).
"""

from __future__ import annotations

import functools
import importlib
import json
import math
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.operators.text import NEGATIVE_HINTS, POSITIVE_HINTS


class Scorer(Protocol):
    def score(self, texts: list[str]) -> list[float | None]: ...


KNOWN: dict[str, str] = {"hint_words": "quillon.operators.scorers:HintWords"}


def register(name: str, factory: str) -> None:
    """``factory`` is ``module:callable`` of a module that workers can import."""
    if ":" not in factory:
        raise ValueError("a factory is named as module:callable")
    KNOWN[name] = factory


@functools.cache
def made(factory: str, settings: str) -> Scorer:
    """The worker's own, made at its first batch."""
    module, name = factory.split(":")
    return getattr(importlib.import_module(module), name)(**json.loads(settings))


def checked(found: list[float | None], n: int) -> list[float | None]:
    if len(found) != n:
        raise ValueError("a scorer gives one value per text")
    return [float(v) if v is not None and math.isfinite(v) else None for v in found]


def scored(df: DataFrame, name: str, text: str = "text", out: str = "score", batch: int = 10, **settings: object) -> DataFrame:
    """``df`` with the scorer's values, NULL where it has none, where it failed, and for null texts, which it isn't shown."""
    if name not in KNOWN:
        raise ValueError(f"no scorer is registered as {name}")
    factory, own = KNOWN[name], json.dumps(settings, sort_keys=True)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(at).to_pylist()
            shown = [k for k, t in enumerate(texts) if t is not None]
            values: list[float | None] = [None] * len(texts)
            for start in range(0, len(shown), batch):
                some = shown[start : start + batch]
                try:
                    found = checked(made(factory, own).score([texts[k] for k in some]), len(some))
                except Exception:  # noqa: BLE001  whatever a model raises, its batch has no scores
                    continue
                for k, v in zip(some, found, strict=True):
                    values[k] = v
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(values, pa.float64())], names=[*whole.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


class HintWords:
    """Balance of leaning words, each distinct word once; None for texts of fewer than ``least`` words."""

    def __init__(self, least: int = 3):
        self.least, self.up, self.down = least, frozenset(POSITIVE_HINTS), frozenset(NEGATIVE_HINTS)

    def score(self, texts: list[str]) -> list[float | None]:
        out: list[float | None] = []
        for t in texts:
            words = t.lower().replace("-", " ").split()
            up, down = len(self.up & set(words)), len(self.down & set(words))
            out.append((up - down) / max(up + down, 1) if len(words) >= self.least else None)
        return out
