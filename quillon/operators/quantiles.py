"""Exact quantiles and ranks in a few passes, without one task that holds a column's values.

A sketch brackets each quantile, one aggregate counts what lies below and within
the bracket, and brackets that still hold too much are bracketed again. What is
left, a bounded number of values, is read off. A pass serves all columns and
quantiles at once and shuffles one row per partition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Bracket:
    """``ranks``, from 0, lie among the ``inside`` values between ``low`` and ``high`` (both included, None: open), above ``below`` others."""

    column: str
    q: float
    ranks: tuple[int, int]
    below: int
    inside: int
    low: float | None = None
    high: float | None = None

    def condition(self) -> Column:
        x = F.col(self.column)
        out = x.isNotNull()
        if self.low is not None:
            out = out & (x >= self.low) & (x <= self.high)
        return out


def narrowed(df: DataFrame, open_: list[Bracket], accuracy: int) -> None:
    """One sketch and one count for all brackets. A sketch that misses its rank leaves the bracket as wide as it can vouch for."""
    margin = 2.0 / accuracy
    shares = [[max(0.0, (b.ranks[0] - b.below) / b.inside - margin), min(1.0, (b.ranks[1] - b.below + 1) / b.inside + margin)] for b in open_]
    sketch = df.agg(*[F.percentile_approx(F.when(b.condition(), F.col(b.column)), s, accuracy).alias(f"q{k}") for k, (b, s) in enumerate(zip(open_, shares, strict=True))], *[f(F.when(b.condition(), F.col(b.column))).alias(f"{n}{k}") for k, b in enumerate(open_) for n, f in (("min", F.min), ("max", F.max))]).first()
    tries = []
    for k in range(len(open_)):
        low, high = sketch[f"q{k}"]
        least, most = sketch[f"min{k}"], sketch[f"max{k}"]
        tries.append((least if shares[k][0] == 0 else low, most if shares[k][1] == 1 else high, least, most))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = df.agg(*[e for k, (b, (low, high, _, _)) in enumerate(zip(open_, tries, strict=True)) for e in (
        count(b.condition() & (F.col(b.column) < low)).alias(f"b{k}"), count(b.condition() & (F.col(b.column) >= low) & (F.col(b.column) <= high)).alias(f"i{k}"),
    )]).first()
    for k, (b, (low, high, least, most)) in enumerate(zip(open_, tries, strict=True)):
        below, inside = b.below + sums[f"b{k}"], sums[f"i{k}"]
        if below <= b.ranks[0] and b.ranks[1] < below + inside:
            b.below, b.inside, b.low, b.high = below, inside, low, high
        else:
            b.low, b.high = least, most


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], discrete: bool = False, most: int = 100_000, accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """The quantiles of each column: interpolated between neighbours, or with ``discrete`` the first value whose cumulative share reaches it.

    Nulls don't count; a column without values has None. ``df`` is read in each
    pass: store what is expensive to compute. At most ``most`` values of a
    bracket, counted by value, reach the driver.
    """
    names = list(wanted)
    counts = df.agg(*[F.count(x).alias(f"n{k}") for k, x in enumerate(names)]).first()
    brackets = []
    for k, x in enumerate(names):
        n = counts[f"n{k}"]
        for q in wanted[x] if n else ():
            at = max(0, math.ceil(q * n) - 1) if discrete else q * (n - 1)
            brackets.append(Bracket(x, q, (math.floor(at), math.ceil(at)), 0, n))
    open_ = [b for b in brackets if b.inside > most]
    while open_:
        before = [(b.inside, b.low, b.high) for b in open_]
        narrowed(df, open_, accuracy)
        # Equal values can't be told apart and needn't be; a bracket that no longer shrinks is counted by value.
        open_ = [b for b, was in zip(open_, before, strict=True) if b.inside > most and b.low < b.high and (b.inside, b.low, b.high) != was]
    values: dict[int, list[tuple[float, int]]] = {k: [] for k in range(len(brackets))}
    if brackets:
        each = F.array(*[F.struct(F.lit(k).alias("k"), F.when(b.condition(), F.col(b.column).cast("double")).alias("x")) for k, b in enumerate(brackets)])
        for r in df.select(F.explode(F.filter(each, lambda e: e["x"].isNotNull())).alias("e")).groupBy("e.k", "e.x").count().collect():
            values[r["k"]].append((r["x"], r["count"]))
    found: dict[str, list[float | None]] = {x: [] for x in names}
    for k, b in enumerate(brackets):
        at, ends = b.below, []
        for x, n in sorted(values[k]):
            at += n
            ends += [x] * ((at > b.ranks[0]) + (at > b.ranks[1]) - len(ends))
            if len(ends) == 2:
                break
        share = 0.0 if discrete else b.q * (counts[f"n{names.index(b.column)}"] - 1) - b.ranks[0]
        found[b.column].append(ends[0] + (ends[1] - ends[0]) * share)
    return {x: found[x] or [None] * len(wanted[x]) for x in names}


def counts_below(values: DataFrame, keys: tuple[str, ...], x: str, n: str, bins: int = 4096) -> DataFrame:
    """``below``: the sum of ``n`` over rows of the same ``keys`` with a smaller ``x``; ``values`` has each ``x`` once per key.

    ``x`` is divided into equal ranges; a row's sum is that of lower ranges, of
    which there are at most ``bins`` per key, and that within its own.
    """
    ends = values.groupBy(*keys).agg(F.min(x).alias("_least"), F.max(x).alias("_most"))
    placed = values.join(ends, list(keys)) if keys else values.join(ends)
    width = F.col("_most") - F.col("_least")
    placed = placed.withColumn("_bin", F.when(width > 0, F.least(F.floor((F.col(x) - F.col("_least")) / width * bins), F.lit(bins - 1))).otherwise(0)).drop("_least", "_most")
    before = lambda *by, order: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = placed.groupBy(*keys, "_bin").agg(F.sum(n).alias(n)).select(*keys, "_bin", before(*keys, order="_bin").alias("_lower"))
    return placed.join(lower, [*keys, "_bin"]).withColumn("below", F.col("_lower") + before(*keys, "_bin", order=x)).drop("_bin", "_lower")
