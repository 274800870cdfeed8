"""The blocked scan of exponential means against the recursion."""

from __future__ import annotations

import random

import pytest

from quillon.operators import ewm


def recursion(values, alpha, least):
    y, age, seen, out = None, 0, 0, []
    for v in values:
        age += 1
        if v is not None:
            old = (1 - alpha) ** age
            y = v if y is None else (old * y + alpha * v) / (old + alpha)
            age, seen = 0, seen + 1
        out.append(y if seen >= least and y is not None else None)
    return out


@pytest.mark.parametrize("rows", [None, 3])
def test_scan_equals_the_recursion(spark, monkeypatch, rows):
    """Gaps, long ones too, leading nulls, an all-null series, extreme values; whole series as a block, and blocks of three rows."""
    if rows:
        monkeypatch.setattr(ewm, "block_rows", lambda alphas: rows)
    rng = random.Random(4)
    series = {f"t{k}": [rng.gauss(50, 20) if rng.random() < (1.0, 0.6, 0.03)[k % 3] else None for _ in range(rng.randint(1, 900))] for k in range(9)}
    series |= {"none": [None] * 20, "one": [None, 7.0, None], "wide": [1e12, 1e-12, -1e12, None, 3.0] * 30, "same": [4.0] * 700}
    df = spark.createDataFrame([(t, d, v, 1) for t, own in series.items() for d, v in enumerate(own)], "ticker string, date int, v double, _other int")
    specs = {"fast": ("v", 0.9, 1), "mid": ("v", 2 / 11, 5), "slow": ("v", 1 / 100, 0)}
    got = {(r.ticker, r.date): r for r in ewm.ewm(df, specs).collect()}
    assert len(got) == sum(map(len, series.values()))
    for t, own in series.items():
        size = max((abs(v) for v in own if v is not None), default=1)
        for out, (_, alpha, least) in specs.items():
            for d, v in enumerate(recursion(own, alpha, least)):
                assert (got[t, d][out] is None) == (v is None)
                assert v is None or got[t, d][out] == pytest.approx(v, rel=1e-9, abs=1e-9 * size)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "ticker string, date int, v double")
    plan = ewm.ewm(df, {"m": ("v", 0.5, 1)})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1
