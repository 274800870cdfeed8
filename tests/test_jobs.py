"""The chained panel jobs: tables by name, checks that stop a job, empty and untidy input."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from quillon import jobs
from quillon.config import Paths, UniverseThresholds
from quillon.operators import universe
from quillon.operators.series import mean_reversion
from quillon.plans import chains
from quillon.sources import sinks

PRICE = "ticker string, date date, open double, high double, low double, close double, volume double, vwap double, transactions double"
MASTER = "ticker string, name string, market_cap double, industry string, sector string"
LIMITS = UniverseThresholds(price=5, average_volume=10, market_cap=100, lookback=3)


def prices(spark, rows):
    return spark.createDataFrame([(t, d and dt.date(2024, 1, d), c, c, c, c, v, c, 1.0) for t, d, c, v in rows], PRICE)


def master(spark, *caps):
    return spark.createDataFrame([(t, t, cap, "i", "s") for t, cap in caps], MASTER)


def test_stages_are_tables(spark, tmp_path):
    a = prices(spark, [("a", d, 10.0, 20.0) for d in (1, 2, 3)] + [("b", d, 1.0, 20.0) for d in (1, 2, 3)] + [(None, 1, 1.0, 1.0), ("a", None, 1.0, 1.0), ("a", 4, -1.0, 5.0)])
    late = prices(spark, [("a", 3, 12.0, 30.0), ("a", 3, 12.0, 30.0)])
    paths = Paths(root=str(tmp_path))
    found = jobs.research_universe([a, late], master(spark, ("a", 200.0), ("b", 200.0), ("c", 200.0)), LIMITS, "2024-02-01", jobs.at(paths))
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{x}.parquet" for x in ("integrity", "reference_master", "research_prices", "research_universe", "universe_prices")]
    got = spark.read.parquet(paths.at("universe_prices"))
    assert {(r.ticker, r.date.day, r.close, r.dollar_volume) for r in got.collect()} == {("A", 1, 10.0, 200.0), ("A", 2, 10.0, 200.0), ("A", 3, 12.0, 360.0)}
    assert {r.ticker: r.eligible for r in found["research_universe"].collect()} == {"A": True, "B": False, "C": False}


def test_failed_checks_stop_the_job(spark):
    a = prices(spark, [("a", 1, 10.0, 20.0)])
    with pytest.raises(universe.QualityError, match="cap_not_positive"):
        jobs.research_universe([a], master(spark, ("a", -1.0)), LIMITS, "2024-02-01")
    with pytest.raises(universe.QualityError, match="future_dates"):
        jobs.research_universe([a], master(spark, ("a", 1.0)), LIMITS, "2023-02-01")


def test_empty_sources(spark):
    found = jobs.research_universe([prices(spark, [])], master(spark), LIMITS, "2024-02-01")
    assert found["universe_prices"].count() == 0
    assert jobs.feature_panel(found["universe_prices"]).count() == 0


def test_whole_chain(spark):
    rows = chains.panel_job(spark, "/root/testdata/sf0.01")
    n = rows.count()
    assert n == rows.select("ticker", "date").distinct().count() == chains.universe_job(spark, "/root/testdata/sf0.01").count()
    assert rows.where("in_universe and log_return_1d_pctrank between 0 and 1").count() > 0
    assert rows.where("log_return_1d_zscore is not null and not in_universe").count() == 0
    assert rows.where("gmm_regime_label is not null").count() > 0


def test_training_panel_has_targets_and_features(spark):
    from quillon.operators.models import pattern_features
    from quillon.sources.panels import bars

    df = jobs.training_panel(bars(spark, "/root/testdata/sf0.01", sectors=True), (4, 13))
    assert {"target_up_4d", "target_up_13d"} <= set(df.columns)
    assert pattern_features(df.columns) == [f"ret_{h}d_voladj_{k}" for h in (5, 21, 63) for k in ("zscore", "pctrank")]
    row = df.selectExpr("count(target_up_13d) AS n", "count(target_up_4d) AS m", "count(ret_5d_voladj_zscore) AS z").first()
    assert 0 < row.n < row.m and row.z > 0


def test_the_mean_reversion_is_written_once(spark):
    """Its hundred columns are the larger part of the disk; the feature panel is a part of the table that has them."""
    sf, kept = "/root/testdata/sf0.01", {}

    def keep(name, df):
        kept[name] = jobs.shared(name, df)
        return kept[name]

    found = jobs.panel(chains.sources(spark, sf), chains.active(spark, sf), chains.LIMITS, chains.TODAY, chains.TRAIN, keep)
    wide = [name for name, df in kept.items() if any(x.startswith("ou_") for x in df.columns)]
    assert wide == ["normalised_panel"]
    want = mean_reversion(found["transformed_panel"])
    got = found["feature_panel"]
    assert sorted(got.columns) == sorted(want.columns) and "gmm_regime_label" in found["normalised_panel"].columns
    assert got.select(want.columns).exceptAll(want).count() == want.exceptAll(got.select(want.columns)).count() == 0


def test_the_feature_job_leaves_its_result_only(spark):
    root = sinks.shared_folder(spark).removeprefix("file://")
    tables = lambda: {p for p in os.listdir(root) if p.startswith("quillon-io-")}
    before = tables()
    out = chains.feature_job(spark, "/root/testdata/sf0.01")
    assert len(tables() - before) == 1 and set(spark.read.parquet(f"{root}/{(tables() - before).pop()}").columns) == set(out.columns)
    assert out.where("ou_log_close_stretch_21 is not null").count() > 0
