"""The panel stages chained into jobs, each stage a table that the next one reads.

A stage is a function of DataFrames; only the tables between stages are
written, so that a stage that fails, or executors that are lost, cost one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import Normalisation, Paths, UniverseThresholds
from quillon.operators import cross, models, regimes, series, shape, universe
from quillon.sources import sinks

Keep = Callable[[str, DataFrame], DataFrame]
RANKED = ("log_return_1d", "garman_klass_var_1d", "volume_robust_z", "trade_size_robust_z", "clv")
REGIME_FEATURES = ("garman_klass_var_1d", "volume_robust_z", "trade_size_robust_z")


def at(paths: Paths) -> Keep:
    """Stages as Parquet files of their names under ``paths``."""

    def keep(name: str, df: DataFrame) -> DataFrame:
        sinks.parquet(df, paths.at(name))
        return df.sparkSession.read.schema(df.schema).parquet(paths.at(name))

    return keep


def shared(name: str, df: DataFrame) -> DataFrame:
    """Stages in the shared folder, gone when the driver ends.

    Spark removes the shuffle files of a stage once the driver's JVM has collected its plan; a driver that does little may not for long.
    """
    out = sinks.stored(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def passing(last: dict[str, tuple[str, ...]], keep: Keep = shared) -> Keep:
    """Stages that are removed once nothing reads them: ``last`` has a stage's name, and those that are read for it for the last time."""
    kept = {}

    def one(name: str, df: DataFrame) -> DataFrame:
        kept[name] = keep(name, df)
        sinks.dropped(*[kept[x] for x in last.get(name, ())])
        return kept[name]

    return one


def research_universe(sources: list[DataFrame], master: DataFrame, limits: UniverseThresholds, today: str, keep: Keep = shared) -> dict[str, DataFrame]:
    """Prices of all sources, the later winning, the master of active instruments, checks, eligible instruments and their prices.

    Raises ``QualityError`` if a check of severity ``fail`` finds rows; the
    checks are one small row each. Rows without ticker or date are left out,
    those without a positive close, too. An empty source gives empty tables.
    """
    prices = universe.clean_keys(universe.merge_sources(*sources)) if len(sources) > 1 else universe.clean_keys(sources[0])
    prices = keep("research_prices", universe.bad_close(prices, "drop").withColumn("dollar_volume", F.col("close") * F.col("volume")))
    master = keep("reference_master", master.withColumns({"ticker": F.upper(F.trim("ticker")), "missing_sector": F.col("sector").isNull(), "missing_market_cap": F.col("market_cap").isNull()}))
    checks = keep("integrity", universe.integrity(prices, master, today))
    if failed := [r.check for r in checks.where("severity = 'fail' and n > 0").orderBy("check").collect()]:
        raise universe.QualityError(f"checks failed: {', '.join(failed)}")
    chosen = keep("research_universe", universe.eligible(prices, master, limits.price, limits.average_volume, limits.market_cap, limits.lookback))
    inside = prices.join(chosen.where("eligible").select("ticker", "sector", "industry"), "ticker")
    return {"research_prices": prices, "reference_master": master, "integrity": checks, "research_universe": chosen, "universe_prices": keep("universe_prices", inside)}


def transformed_panel(prices: DataFrame, keep: Keep = shared) -> DataFrame:
    """Transformed prices with sector ranks. ``prices`` carries ``sector``."""
    return keep("transformed_panel", shape.sector_ranks(shape.transformed(prices), RANKED))


def feature_panel(prices: DataFrame, keep: Keep = shared) -> DataFrame:
    """The transformed panel with the mean reversion of its features."""
    return keep("feature_panel", series.mean_reversion(transformed_panel(prices, keep)))


def regime_tables(panel: DataFrame, train_until: str, keep: Keep = shared, features: tuple[str, ...] = REGIME_FEATURES) -> dict[str, DataFrame]:
    """The mixture's label of each row, and the runs, their summary and the transitions between labels."""
    fitted = models.RegimeModel(features).fit(panel.where(F.col("date") <= train_until))
    labels = keep("gmm_regimes", fitted.transform(panel.select("ticker", "date", *features)).drop(*features))
    runs = keep("regime_runs", regimes.runs(labels, "gmm_regime_label"))
    return {"gmm_regimes": labels, "regime_runs": runs, "regime_summary": keep("regime_summary", regimes.run_summary(runs, "gmm_regime_label")), "regime_transitions": keep("regime_transitions", regimes.transitions(labels, "gmm_regime_label"))}


def normalised_panel(prices: DataFrame, x: str, least_price: float, least_volume: float, keep: Keep = shared, n: Normalisation = Normalisation()) -> DataFrame:
    """Lagged membership, and the sector rank and lagged z-score of ``x`` among members.

    The windows ship only what they read; the panel's other columns, a hundred and more, meet their results in one join.
    """
    narrow = prices.select(*dict.fromkeys(("ticker", "date", "sector", "close", "volume", x)))
    members = cross.with_members(narrow, n.lag, least_price, least_volume, n.history)
    made = cross.lagged_normalised(members, x, n.deviations, n.least_members, n.norm_window, n.norm_least)
    made = sinks.stored(made.drop(*[y for y in narrow.columns if y not in ("ticker", "date")]))
    kept = [y for y in prices.columns if y in ("ticker", "date") or y not in made.columns]
    return keep("normalised_panel", prices.select(*kept).join(made, ["ticker", "date"], "left"))


def training_panel(prices: DataFrame, horizons: tuple[int, ...], keep: Keep = shared, n: Normalisation = Normalisation()) -> DataFrame:
    """Targets of each horizon, and sector z-scores and ranks of trailing returns over volatility, what :func:`quillon.operators.training.train` takes."""
    df = cross.institutional(prices, n.trailing, n.forward, n.lag, n.history, n.volatility_floor)
    for h in n.trailing:
        df = cross.sector_normalised(df, f"ret_{h}d_voladj", n.deviations, n.least_members)
    for h in horizons:
        df = df.drop(f"fwd_ret_{h}d")
        df = models.targets(df, h, ())
    return keep("training_panel", df)


def panel(sources: list[DataFrame], master: DataFrame, limits: UniverseThresholds, today: str, train_until: str, keep: Keep = shared) -> dict[str, DataFrame]:
    """The whole chain: universe, features, regimes, normalisation; all its tables by name.

    Regimes and normalisation stand on the transformed panel. The mean reversion
    adds its hundred columns last, so that they are shipped nowhere and written
    once: the feature panel is the normalised panel without what those two add.
    """
    out = research_universe(sources, master, limits, today, keep)
    out["transformed_panel"] = narrow = transformed_panel(out["universe_prices"], keep)
    out |= regime_tables(narrow, train_until, keep)
    labelled = narrow.join(out["gmm_regimes"], ["ticker", "date"], "left")
    normalised = normalised_panel(labelled, "log_return_1d", limits.price, limits.average_volume, lambda name, df: df)
    out["normalised_panel"] = whole = keep("normalised_panel", series.mean_reversion(normalised))
    added = set(normalised.columns) - set(narrow.columns)
    out["feature_panel"] = whole.select(*[x for x in whole.columns if x not in added])
    return out
