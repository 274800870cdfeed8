"""What operators ship and sort, and in how many tasks, on plans that don't grow worse with the input."""

from __future__ import annotations

import datetime as dt

from quillon import jobs
from quillon.functions import columns as c
from quillon.operators import series
from quillon.sources import panels

KEYS = "ticker string, date date, sector string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_rank_costs_one_sort(spark):
    df = spark.createDataFrame([], f"{KEYS}, x double").withColumn("r", c.rank_share("x", "date", "sector"))
    assert plan(df).count("Window [") == plan(df).count("Sort [") == 1


def test_a_rank_is_over_known_values_whatever_the_order(spark):
    rows = [("a", dt.date(2024, 1, 1), "s", x) for x in (3.0, 1.0, None, 1.0, -0.0, 0.0)]
    df = spark.createDataFrame(rows, f"{KEYS}, x double").select("x", c.rank_share("x", "date").alias("up"), c.rank_share("x", "date", descending=True).alias("down"))
    found = {(None if r.x is None else r.x + 0.0): (r.up, r.down) for r in df.collect()}
    assert found == {3.0: (1.0, 0.2), 1.0: (0.7, 0.5), 0.0: (0.3, 0.9), None: (None, None)}


def test_mean_reversion_ships_its_columns_nowhere(spark):
    df = series.mean_reversion(spark.createDataFrame([], f"{KEYS}, log_close double"), ("log_close",))
    assert plan(df).count("Exchange hashpartitioning") == 1
    assert "Window [" not in plan(df)


def test_stretch_velocities_are_differences_by_row(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(k), "s", ((k * 37) % 11) / 10 + (k % 3)) for k in range(60)] + [("b", dt.date(2024, 1, 1), "s", 1.0)]
    df = series.mean_reversion(spark.createDataFrame(rows, f"{KEYS}, log_close double"), ("log_close",), (21,))
    wrong = df.withColumn("_d", c.diff("ou_log_close_stretch_21", 5)).where("not (_d <=> ou_log_close_stretch_vel_5d_21)")
    assert df.count() == 61 and wrong.count() == 0


def test_normalisation_windows_leave_other_columns_alone(spark):
    rows = [(f"t{k}", dt.date(2024, 1, 1) + dt.timedelta(d), "s", 20.0 + k, 1e6, float((k * d) % 7), 1.0) for k in range(12) for d in range(5)]
    wide = spark.createDataFrame(rows, f"{KEYS}, close double, volume double, x double, other double")
    kept = {}
    jobs.normalised_panel(wide, "x", 1.0, 1.0, keep=lambda name, df: kept.setdefault(name, df))
    out = kept["normalised_panel"]
    assert "Window [" not in plan(out)
    assert out.count() == len(rows) and {*wide.columns, "in_universe", "x_pctrank", "x_zscore"} <= set(out.columns)
    assert out.where("other is null").count() == 0


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(panels, "ROWS_A_TASK", 10)
    df = spark.range(95).withColumnRenamed("id", "k")
    assert panels.dealt(df, "k").rdd.getNumPartitions() == 10
    assert panels.dealt(df, "k").count() == 95
