"""Rolling statistics over arrays against Spark's frames and against definitions; what the summary and the residual compute once."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import columns as c
from quillon.operators import rolled, series
from quillon.plans import overlays


def walk(n: int, seed: int) -> list[float | None]:
    rng = np.random.default_rng(seed)
    return [None if rng.random() < 0.02 else float(x) for x in 100 + rng.normal(0, 1, n).cumsum()]


def test_statistics_equal_frames(spark):
    x, y = walk(300, 1), walk(300, 2)
    x[200:240] = [x[200] or 1.0] * 40  # constant for longer than the frame
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(k), *v) for k, v in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "ticker string, date date, x double, y double")
    want = df.select("date", c.mean("x", 20).alias("mean"), c.std("x", 20).alias("std"), c.high("x", 20).alias("high"), c.div(F.col("x") - c.mean("x", 20), c.std("x", 20), 1e-12).alias("z"), c.correlation("x", "y", 20, 20).alias("r"), c.change("x").alias("change"), c.diff("x", 3).alias("diff"))
    u, v = (np.array([np.nan if e is None else e for e in s]) for s in (x, y))
    got = {"mean": rolled.mean(u, 20), "std": rolled.std(u, 20), "high": rolled.high(u, 20), "z": rolled.z(u, 20, 1e-12), "r": rolled.correlations(u, [v], 20)[0], "change": rolled.change(u), "diff": rolled.diff(u, 3)}
    for k, r in enumerate(want.orderBy("date").collect()):
        for name, found in got.items():
            assert (None if np.isnan(found[k]) else found[k]) == (None if r[name] is None else pytest.approx(r[name], abs=1e-9)), (k, name)
    assert np.isnan(rolled.z(u, 20, 1e-12)[225]) and rolled.std(u, 20)[225] == 0


def test_blocks_of_rows_change_nothing():
    x = np.random.default_rng(3).normal(0, 1, 95)
    whole, parts = (rolled.over(20, lambda w: w.sum(1), x, block=b) for b in (1000, 7))
    assert len(parts) == 95 and np.array_equal(whole, parts, equal_nan=True)


def test_long_frames_are_no_windows(spark):
    """The residual's correlations and the stress components slide over no frame by instrument, and calendars aren't shuffled against a panel."""
    panel = spark.createDataFrame([], "ticker string, date date, close double, high double, low double, volume double, vwap double")
    proxies = spark.createDataFrame([], "label string, date date, close double")
    residual = series.residual_pressure(panel, proxies, ("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "-59" not in residual and "FlatMapGroupsInArrow" in residual and "SortMergeJoin" not in residual
    stress = series.stress(panel)._jdf.queryExecution().executedPlan().toString()
    assert "-19" not in stress and "-59" not in stress


def test_the_summary_makes_bars_once(spark, sf_dir, monkeypatch):
    made = []
    bars = overlays.bars
    monkeypatch.setattr(overlays, "bars", lambda *a, **k: made.append(a) or bars(*a, **k))
    overlays.regime_summary(spark, sf_dir)
    assert len(made) == 1
