"""Each registered panel query against its SQL; the others for rows and a stable schema."""

from __future__ import annotations

import pytest

from quillon.plans import catalog
from tests.compare import assert_same

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
TRAINED = {"m06_m07_fold_metrics", "k07_training_report", "k07_m07_mean_importance", "k07_prediction_bands", "k07_m08_fold_ensemble"}
FITTED = TRAINED | {"m01_mixture_regimes", "m01_mixture_grid", "m03_fx09_expanding_regimes", "m07_m09_f24_classifier", "m07_importance"}


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - FITTED))
def test_rows_only(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert QUERIES[name](spark, sf_dir).schema == df.schema


@pytest.mark.parametrize("name", ["m01_mixture_regimes", "m07_m09_f24_classifier"])
def test_models(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").limit(500).collect()
    assert rows
    for r in rows:
        for p in map(r.asDict().get, ("p", "calibrated_p", "logistic_p", "gmm_regime_confidence")):
            assert p is None or 0 <= p <= 1


def test_regimes_use_all_numbers_of_components(spark, sf_dir):
    """The labels are those of the number of components with the least BIC, of 3 to 6."""
    grid = {r.components: r for r in QUERIES["m01_mixture_grid"](spark, sf_dir).collect()}
    assert set(grid) == {3, 4, 5, 6}
    chosen = min(grid, key=lambda k: grid[k].bic)
    assert [k for k in grid if grid[k].chosen] == [chosen]
    labels = QUERIES["m01_mixture_regimes"](spark, sf_dir).select("gmm_regime_label").distinct().collect()
    assert {r.gmm_regime_label for r in labels} <= {None, *range(chosen)}


def test_training_queries_share_their_fits(spark):
    found = {name: QUERIES[name](spark, "/root/testdata/sf0.01").collect() for name in sorted(TRAINED)}
    fits = [r for r in found["m06_m07_fold_metrics"] if r.status == "fitted"]
    assert fits and all(r.trees < r.most_trees and 0.5 < r.auc < 1 and 0 < r.brier < 0.25 for r in fits)
    assert {r.target for r in found["k07_training_report"]} == {"target_up_4d", "target_gain_5"}
    assert sum(r["rows"] for r in found["k07_prediction_bands"]) == sum(r.validation_rows for r in fits)
    assert all(0 <= r.ensemble_p <= 1 for r in found["k07_m08_fold_ensemble"])


def test_expanding_regimes_use_the_least_training_of_the_method(spark, sf_dir):
    df = QUERIES["m03_fx09_expanding_regimes"](spark, sf_dir)
    assert [x for x in df.columns if x.startswith("regime_prob_")] == [f"regime_prob_{k}" for k in range(4)]
    assert min(r.fitted_rows for r in df.collect()) == 252


def test_importances_are_shares(spark):
    rows = QUERIES["m07_importance"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.importance for r in rows) == pytest.approx(1)


def test_calibration_follows_the_out_of_fold_predictions(spark):
    """Held-out predictions twice as extreme as the labels: both forms pull towards the labels' rates."""
    from quillon.operators import models

    held = spark.createDataFrame([(float(k % 10 < (6 if p > 0.5 else 4)), p) for p in (0.1, 0.9) for k in range(200)], "label double, p double")
    df = spark.createDataFrame([(0.1,), (0.9,), (None,)], "p double")
    for logistic in (False, True):
        got = {r.p: r.calibrated_p for r in models.calibrated(held, df, logistic=logistic).collect()}
        assert got == {0.1: pytest.approx(0.4, abs=0.01), 0.9: pytest.approx(0.6, abs=0.01)}


def test_regime_summary_equals_brute_force(spark):
    import math

    from quillon.operators import regimes

    names = ["stock_regime_signal", "macro_regime_score", "sector_relative_strength_20d", "sector_vol_prob", "sector_risk_multiplier", "price_vs_sma20", "rsi_14", "ret_20d_back", "breakout_20d_high_flag", "breakdown_20d_low_flag", "ret_60d_back", "sma20_slope_5", "ema10_slope_5", "realized_vol_20", "ret_90d_back", "dist_from_20d_high", "vdce_signal", "vdce_leader_score"]
    rows = [tuple(((7 * i + 3 * j) % 19 - 9) / (2 if n == "rsi_14" else 20) if (i + j) % 6 else None for j, n in enumerate(names)) for i in range(12)]
    df = spark.createDataFrame([(i, "neutral", "ORANGE", *r) for i, r in enumerate(rows)], "ticker int, macro_regime_label string, vdce_market_state string, " + ", ".join(f"{n} double" for n in names))
    bound = lambda x, lo=-1, hi=1: max(lo, min(hi, x))
    for r in regimes.summary(df).collect():
        lean = lambda x, scale: math.tanh(r[x] / scale) if r[x] is not None else 0.0  # noqa: B023, E731
        value = lambda x, default: default if r[x] is None else r[x]  # noqa: B023, E731
        sector = bound(0.45 * lean("sector_relative_strength_20d", 0.05) + 0.35 * (0.5 - value("sector_vol_prob", 0.5)) + 0.2 * (value("sector_risk_multiplier", 1) - 1))
        tech = bound(0.3 * lean("price_vs_sma20", 0.05) + 0.2 * (value("rsi_14", 50) - 50) / 50 + 0.2 * lean("ret_20d_back", 0.12) + 0.15 * value("breakout_20d_high_flag", 0) - 0.15 * value("breakdown_20d_low_flag", 0))
        assert r.sector_signal == pytest.approx(sector) and r.tech_signal_20d == pytest.approx(tech)
        stress = rows[r.ticker][names.index("vdce_signal")]
        stress = None if stress is None else bound(stress - 0.2 * lean("vdce_leader_score", 0.1))
        assert r.vdce_signal == (None if stress is None else pytest.approx(stress))
        score = bound(sum(regimes.WEIGHTS[20][k] * (x or 0) for k, x in (("stock", r.stock_regime_signal), ("macro", r.macro_regime_score), ("sector", sector), ("tech", tech), ("vdce", stress))))
        assert r.regime_20d_score == pytest.approx(score)
        covered = sum(x is not None for x in (r.stock_regime_signal, r.macro_regime_score, sector, tech)) / 4
        assert r.regime_20d_confidence == pytest.approx(bound((0.38 + 0.42 * abs(score) + 0.2 * covered) * 0.7, 0.2, 0.99))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
