"""Null edges and invariants of the column factories."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import columns as c
from quillon.operators import regimes, shape, universe
from quillon.operators.ewm import ewm

DAY = dt.date(2024, 1, 1)


def series(spark, values, ticker="A"):
    return spark.createDataFrame([(ticker, DAY + dt.timedelta(k), v) for k, v in enumerate(values)], "ticker string, date date, x double")


def column(df, expr):
    return [r.y for r in df.select("date", expr.alias("y")).orderBy("date").collect()]


def test_division_and_clip_keep_nulls(spark):
    df = series(spark, [0.0, 2.0, None, -4.0])
    assert column(df, c.div(F.lit(1.0), "x")) == [None, 0.5, None, -0.25]
    assert column(df, c.clip("x", -1, 1)) == [0.0, 1.0, None, -1.0]
    assert column(df, c.log("x")) == [None, pytest.approx(0.6931472), None, None]


def test_rolling_counts_values_not_rows(spark):
    df = series(spark, [1.0, None, 3.0, 5.0])
    assert column(df, c.mean("x", 3, 2)) == [None, None, 2.0, 4.0]
    assert column(df, c.total("x", 2)) == [None, None, None, 8.0]


def test_rank_share_averages_ties_and_skips_nulls(spark):
    df = series(spark, [1.0, 1.0, 3.0, None])
    assert column(df, c.rank_share("x", "ticker")) == [0.5, 0.5, 1.0, None]
    assert column(df, c.rank_share("x", "ticker", descending=True)) == [pytest.approx(5 / 6), pytest.approx(5 / 6), pytest.approx(1 / 3), None]


def test_ewm_ages_weights_over_gaps(spark):
    values = [None, 1.0, None, 2.0, 4.0, None]
    got = column(ewm(series(spark, values), {"y0": ("x", 0.3, 2)}), F.col("y0"))
    expected = pd.Series(values, dtype="float64").ewm(alpha=0.3, adjust=False, min_periods=2).mean()
    assert [None if pd.isna(v) else pytest.approx(v) for v in expected] == [None if pd.isna(v) else v for v in [float("nan") if g is None else g for g in got]]


def test_correlation_of_a_constant_is_null(spark):
    df = series(spark, [0.1 + 0.2] * 30).withColumn("k", F.rand(1))
    assert column(df, c.correlation("x", "k", 5, 5))[-1] is None


def test_no_look_ahead(spark):
    """Cutting the future off leaves the past as it is."""
    rows = [("A", DAY + dt.timedelta(k), 10.0 + k % 7, 12.0 + k % 7, 9.0 + k % 5, 11.0 + k % 6, 100.0 + k, 10.5, 5.0) for k in range(90)]
    schema = "ticker string, date date, open double, high double, low double, close double, volume double, vwap double, transactions double"
    whole = shape.volume_structure(spark.createDataFrame(rows, schema)).orderBy("date").collect()[:60]
    cut = shape.volume_structure(spark.createDataFrame(rows[:60], schema)).orderBy("date").collect()
    assert whole == [r for r in cut] or [r.asDict() | {"_n": 0} for r in whole] == [r.asDict() | {"_n": 0} for r in cut]


def test_fractional_weights():
    w = shape.binomial_weights(0.4, 1e-3)
    assert w[:4] == [1.0, 0.4, pytest.approx(-0.12), pytest.approx(0.064)]
    assert len(w) == 55


def test_runs_and_transition_shares(spark):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(k), v) for k, v in enumerate([1, 1, None, 1, 2, 2, 1])], "ticker string, date date, regime int")
    assert sorted((r.regime, r.duration_rows) for r in regimes.runs(df).collect()) == [(1, 1), (1, 3), (2, 2)]
    assert {(r.from_regime, r.to_regime): r.transition_prob for r in regimes.transitions(df).collect()} == {(1, 2): 1.0, (2, 1): 1.0}


def test_merge_lets_the_later_source_win(spark):
    a = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "ticker string, date int, x double")
    b = spark.createDataFrame([("A", 1, 9.0)], "ticker string, date int, x double")
    assert sorted((r.ticker, r.x) for r in universe.merge_sources(a, b).collect()) == [("A", 9.0), ("B", 2.0)]


def test_bad_close_policies(spark):
    df = spark.createDataFrame([(1.0, 1.0), (-1.0, 1.0), (None, 1.0)], "close double, volume double")
    assert universe.bad_close(df, "drop").count() == 1
    assert universe.bad_close(df, "null").where("close is null").count() == 2
    with pytest.raises(universe.QualityError):
        universe.bad_close(df, "fail")
    with pytest.raises(universe.QualityError):
        universe.bad_close(df.withColumn("volume", F.lit(-1.0)), "drop")


def test_unique_join_checks_cardinality(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    assert universe.unique_join(a, b, "k").count() == 2
    with pytest.raises(universe.QualityError):
        universe.unique_join(a, b, "k", validate="1:1")
    with pytest.raises(universe.QualityError):
        universe.unique_join(b, a, "k")


def test_code_sector_takes_the_first_range(spark):
    got = spark.createDataFrame([("3711",), ("3575",), ("x",), (None,), ("6550",)], "c string").select(universe.code_sector("c").alias("s")).collect()
    assert [r.s for r in got] == ["Industrials", "Industrials", "Unknown", "Unknown", "Real Estate"]


def test_reversion_closes_gaps(spark):
    """Each row against a fit on the known values of its last rows, gaps closed; an instrument without values gets NULLs."""
    import math
    import random
    from datetime import date, timedelta

    from quillon.operators import series

    rnd, rows, n, least = random.Random(5), [], 12, 6
    for ticker, gaps in (("a", 0.0), ("b", 0.3), ("c", 1.0), ("d", 0.6)):
        x = 0.0
        for k in range(60):
            x = 0.6 * x + rnd.gauss(0, 1)
            rows.append((ticker, date(2024, 1, 1) + timedelta(k), None if rnd.random() < gaps else x))
    df = spark.createDataFrame(rows, "ticker string, date date, x double").repartition(3, "x")
    got = {(r.ticker, r.date): r for r in series.mean_reversion(df, ("x",), (n,), least).collect()}
    assert len(got) == len(rows)
    fitted = 0
    for ticker in "abcd":
        own = [r for r in rows if r[0] == ticker]
        for k, (_, day, x) in enumerate(own):
            v = [y for *_, y in own[max(k - n, 0) : k] if y is not None]
            want = None
            if k >= n and x is not None and len(v) >= least:
                a, b = v[:-1], v[1:]
                ma, mb = sum(a) / len(a), sum(b) / len(b)
                slope = sum((p - ma) * (q - mb) for p, q in zip(a, b)) / sum((p - ma) ** 2 for p in a)
                want = slope if 0 < slope < 1 else None
            r = got[ticker, day]
            if want is None:
                assert r.ou_x_b_12 is None and r.ou_x_stretch_12 is None and not r.ou_x_valid_12
                continue
            fitted += 1
            mu = (mb - want * ma) / (1 - want)
            rest = sum((q - mb - want * (p - ma)) ** 2 for p, q in zip(a, b))
            sigma = math.sqrt(rest / (len(a) - 1)) / math.sqrt(1 - want * want)
            assert r.ou_x_b_12 == pytest.approx(want) and r.ou_x_mu_12 == pytest.approx(mu) and r.ou_x_sigma_eq_12 == pytest.approx(sigma)
            assert r.ou_x_stretch_12 == pytest.approx((x - mu) / sigma) and r.ou_x_half_life_12 == pytest.approx(math.log(2) / -math.log(want))
            assert r.ou_x_r_squared_12 == pytest.approx(1 - rest / sum((q - mb) ** 2 for q in b))
    assert fitted > 50
