"""Statistics of the last ``n`` values of one series, for Arrow passes by instrument.

A sliding frame of Spark's adds up all its rows anew for every row and every
function, which for tens of functions over 60 rows costs a hundred times what
a pass over arrays does. Missing is NaN here; a frame with a missing value, or
with fewer than ``n`` rows, has NaN. Values are taken relative to the frame's last
one, so that a constant frame has a deviation of exactly 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def over(n: int, f: Callable, *xs: np.ndarray, block: int = 10_000) -> np.ndarray:
    """``f`` of the frames (rows by ``n``) of each series, a block of rows at a time; ``f`` gives rows last."""
    padded = [np.concatenate([np.full(n - 1, np.nan), x]) for x in xs]
    parts = [f(*[sliding_window_view(p[k : k + block + n - 1], n) for p in padded]) for k in range(0, len(xs[0]), block)]
    return np.concatenate(parts, axis=-1)


def centred(w: np.ndarray) -> np.ndarray:
    d = w - w[:, -1:]
    return d - d.mean(1, keepdims=True)


def mean(x: np.ndarray, n: int) -> np.ndarray:
    return over(n, lambda w: w[:, -1] + (w - w[:, -1:]).mean(1), x)


def high(x: np.ndarray, n: int) -> np.ndarray:
    return over(n, lambda w: w.max(1), x)


def std(x: np.ndarray, n: int, free: int = 1) -> np.ndarray:
    return over(n, lambda w: np.sqrt((centred(w) ** 2).sum(1) / (n - free)), x)


def ratio(a: np.ndarray, b: np.ndarray, tiny: float = 0.0) -> np.ndarray:
    """``a / b``; NaN where ``b`` is not above ``tiny`` in size."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=np.abs(b) > tiny)


def z(x: np.ndarray, n: int, tiny: float = 0.0, free: int = 1) -> np.ndarray:
    """Deviation of the frame's last value from its mean in the frame's deviations."""

    def of(w: np.ndarray) -> np.ndarray:
        d = centred(w)
        return ratio(d[:, -1], np.sqrt((d**2).sum(1) / (n - free)), tiny)

    return over(n, of, x)


def diff(x: np.ndarray, k: int = 1) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[k:] - x[:-k]])


def change(x: np.ndarray) -> np.ndarray:
    return ratio(x, np.concatenate([[np.nan], x[:-1]])) - 1


def correlations(x: np.ndarray, ys: list[np.ndarray], n: int) -> np.ndarray:
    """Pearson correlation of ``x`` with each of ``ys`` (a row for each); NaN where either is constant."""

    def of(w: np.ndarray, *others: np.ndarray) -> np.ndarray:
        dx = centred(w)
        out = []
        for other in others:
            dy = centred(other)
            out.append(ratio((dx * dy).mean(1), np.sqrt((dx**2).mean(1)) * np.sqrt((dy**2).mean(1))))
        return np.array(out)

    return over(n, of, x, *ys)


def by_instrument(df: DataFrame, columns: tuple[str, ...], f: Callable[..., dict[str, np.ndarray]], made: tuple[str, ...]) -> DataFrame:
    """``df`` with the columns ``made`` that ``f`` gives of an instrument's ``columns`` in the order of dates. What ``df`` carries beyond them isn't pruned."""

    def fold(g: pa.Table) -> pa.Table:
        g = g.sort_by("date")
        found = f(*[np.asarray(g.column(x).cast(pa.float64()).to_numpy(), dtype=float) for x in columns])
        for name in made:
            g = g.append_column(name, pa.array(found[name], pa.float64(), from_pandas=True))
        return g

    return df.groupBy("ticker").applyInArrow(fold, T.StructType([*df.schema.fields, *[T.StructField(x, T.DoubleType()) for x in made]]))
