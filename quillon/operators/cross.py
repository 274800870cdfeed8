"""Sector overlays and cross-sectional normalisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import columns as c


def by(column: str) -> WindowSpec:
    return Window.partitionBy(column).orderBy("date")


def sector_daily(df: DataFrame) -> DataFrame:
    """A row per (date, sector): members, four means, market means, relative strength, volatility, risk flag.

    Pre-aggregated on the map side; what follows works on one row per sector
    and date. Rows without ticker, date or sector are left out.
    """
    known = df.where("ticker is not null and date is not null and sector is not null")
    per = known.groupBy("date", "sector").agg(
        F.count_distinct("ticker").alias("sector_member_count"), F.avg("log_return_1d").alias("sector_return_1d"), F.avg("garman_klass_var_1d").alias("sector_volatility_1d"),
        F.avg("volume_robust_z").alias("sector_volume_shock_1d"), F.avg("trade_size_robust_z").alias("sector_trade_size_shock_1d"),
    )
    market = known.groupBy("date").agg(F.avg("log_return_1d").alias("market_return_1d")).withColumn("_one", F.lit(1))
    # One row per date: the whole calendar fits one task at any number of instruments.
    market = market.withColumn("market_return_20d_mean", c.mean("market_return_1d", 20, w=by("_one"))).drop("_one")
    out = per.join(market, "date", "left").withColumns({"sector_return_20d_mean": c.mean("sector_return_1d", 20, w=by("sector")), "sector_realized_vol_20d": c.std("sector_return_1d", 20, w=by("sector"))})
    return out.withColumns({"sector_relative_strength_20d": F.col("sector_return_20d_mean") - F.col("market_return_20d_mean"), "sector_high_risk_flag": F.when(F.col("sector_return_1d") < -0.02, 1).otherwise(0)})


def sector_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where("sector is not null").groupBy("date", "sector").agg(*[F.avg(x).alias(f"sector_{x}") for x in columns])


def contagion(daily: DataFrame, x: str = "sector_return_1d", n: int = 20, least: int = 3) -> DataFrame:
    """Mean absolute correlation of a sector with the others over the last ``n`` dates.

    Means and deviations are each sector's own over its known dates, the
    covariance is over joint ones. The grid of dates and sectors is completed
    first, so that frames count dates; sectors are few, so that their pairs
    are, too.
    """
    dates, sectors = daily.select("date").distinct(), daily.select("sector").distinct()
    grid = dates.crossJoin(sectors).join(daily.select("date", "sector", F.col(x).alias("x")), ["date", "sector"], "left")
    own = c.frame(n, w=by("sector"))
    stats = grid.withColumns({"k": F.count("x").over(own), "m": F.avg("x").over(own), "s": F.stddev_pop("x").over(own), "i": F.row_number().over(by("sector"))})
    a, b = (stats.select("date", *[F.col(y).alias(f"{y}{p}") for y in ("sector", "x", "k", "m", "s", "i")]) for p in "ab")
    pairs = a.join(b, "date").where("sectora <> sectorb")
    w = Window.partitionBy("sectora", "sectorb").orderBy("date").rowsBetween(-(n - 1), 0)
    joint = F.when(F.col("xa").isNotNull() & F.col("xb").isNotNull(), 1)
    xa, xb = F.when(joint == 1, F.col("xa")), F.when(joint == 1, F.col("xb"))
    count = F.count(joint).over(w)
    cov = (F.sum(xa * xb).over(w) - F.col("ma") * F.sum(xb).over(w) - F.col("mb") * F.sum(xa).over(w) + count * F.col("ma") * F.col("mb")) / count
    ready = (count >= least) & (F.col("ka") >= least) & (F.col("kb") >= least) & (F.col("sa") >= 1e-12) & (F.col("sb") >= 1e-12)
    r = F.when(ready, c.clip(cov / (F.col("sa") * F.col("sb")), -1, 1))
    out = pairs.withColumn("r", F.abs(r)).where(F.col("ia") >= n).groupBy("date", F.col("sectora").alias("sector")).agg(F.avg("r").alias("sector_contagion_score_20d"))
    return out


def overlay(daily: DataFrame, means: DataFrame | None = None) -> DataFrame:
    out = daily if means is None else daily.join(means, ["date", "sector"], "left")
    return out.join(contagion(daily), ["date", "sector"], "left")


def with_members(df: DataFrame, lag: int = 2, least_price: float = 10.0, least_volume: float = 300_000.0, history: int = 60) -> DataFrame:
    """Lagged universe membership: price, average volume and quality as of ``lag`` rows ago, enough clean rows before."""
    df = df.withColumn("_fail", F.col("close").isNull() | (F.col("close") <= 0) | F.col("volume").isNull() | (F.col("volume") <= 0))
    df = df.withColumns({"_fail_lagged": F.coalesce(c.lag("_fail", lag), F.lit(True)), "price_filter_lagged": c.lag("close", lag), "_lv": c.lag("volume", lag), "_log": c.log("close")})
    df = df.withColumn("_r", c.diff("_log"))
    df = df.withColumns({"adv_22d_lagged": c.mean("_lv", 22, 11), "_lr": c.lag("_r", lag), "_clean": c.running(F.when(F.col("_fail_lagged"), 0).otherwise(1))})
    df = df.withColumn("vol_22d_lagged", c.clip(c.std("_lr", 22, 22), 1e-6))
    inside = (F.col("price_filter_lagged") >= least_price) & (F.col("adv_22d_lagged") >= least_volume) & (F.col("_clean") >= history) & ~F.col("_fail_lagged")
    return df.withColumn("in_universe", F.coalesce(inside, F.lit(False)))


def lagged_normalised(df: DataFrame, x: str, k: float = 5.0, least: int = 10, window: int = 63, window_least: int = 20) -> DataFrame:
    """Rank of the winsorized value in its sector and date; z-score by the sector's past daily means and deviations.

    Only rows in the universe with a value and a sector count. At deviation 0
    values aren't clipped.
    """
    valid = F.col("in_universe") & F.col(x).isNotNull() & F.col("sector").isNotNull()
    rows = df.where(valid).withColumn("_med", c.group_median(x, "date", "sector"))
    rows = rows.withColumn("_clip", c.winsorized(x, "date", "sector", k=k, collapse=False))
    enough = F.count("_clip").over(Window.partitionBy("date", "sector")) >= least
    rows = rows.withColumn(f"{x}_pctrank", F.when(enough, c.rank_share("_clip", "date", "sector")))
    daily = rows.groupBy("date", "sector").agg(F.avg("_clip").alias("m"), F.stddev_samp("_clip").alias("s"), F.count("_clip").alias("n"))
    daily = daily.withColumns({y: F.when(F.col("n") >= least, F.col(y)) for y in "ms"})
    daily = daily.select("date", "sector", *[c.rolling(F.avg, y, window, window_least, 1, by("sector")).alias(f"_l{y}") for y in "ms"])
    out = rows.join(daily, ["date", "sector"], "left").withColumn(f"{x}_zscore", F.when(F.col("_ls") > 0, (F.col("_clip") - F.col("_lm")) / F.col("_ls")))
    keep = out.select("ticker", "date", f"{x}_pctrank", f"{x}_zscore")
    return df.join(keep, ["ticker", "date"], "left")


def institutional(df: DataFrame, trailing: tuple[int, ...] = (5, 21, 63), forward: tuple[int, ...] = (20, 60, 90), lag: int = 2, history: int = 60, floor: float = 0.005) -> DataFrame:
    """Log returns, forward returns and returns over lagged volatility, by instrument."""
    df = df.withColumn("_log", c.log("close")).withColumn("valid_close", F.col("close").isNotNull())
    df = df.withColumns({"_r": c.diff("_log"), "history_days": c.running(F.col("valid_close").cast("int"))})
    df = df.withColumns({"_lr": c.lag("_r", lag), **{f"ret_{h}d": c.diff("_log", h) for h in trailing}, **{f"fwd_ret_{h}d": c.lag("_log", -h) - F.col("_log") for h in forward}, "in_universe": (F.col("history_days") >= history) & F.col("valid_close")})
    df = df.withColumn("vol_22d", c.clip(c.std("_lr", 22, 10), floor))
    return df.withColumns({f"ret_{h}d_voladj": c.div(f"ret_{h}d", F.col("vol_22d") * F.sqrt(F.lit(float(h)))) for h in trailing})


def sector_normalised(df: DataFrame, x: str, k: float = 5.0, least: int = 10) -> DataFrame:
    """z-score of the winsorized value and rank of the raw one, within date and sector, for rows in the universe.

    Here a deviation of 0 collapses values to the median.
    """
    value = F.when(F.col("in_universe") & F.col("sector").isNotNull(), F.col(x))
    df = df.withColumn("_v", value).withColumn("_med", c.group_median("_v", "date", "sector"))
    df = df.withColumn("_clip", c.winsorized("_v", "date", "sector", k=k))
    enough = F.count("_v").over(Window.partitionBy("date", "sector")) >= least
    return df.withColumns({f"{x}_zscore": F.when(enough, c.group_z("_clip", "date", "sector", least=least)), f"{x}_pctrank": F.when(enough, c.rank_share("_v", "date", "sector"))}).drop("_v", "_med", "_clip")


def scores(v: np.ndarray, k: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """z-score of the winsorized values of one group and rank of the raw ones; NaN is missing.

    Values are taken relative to their median, so that a group that collapses to it has a deviation of exactly 0.
    """
    z, rank = np.full((2, len(v)), np.nan)
    known = np.flatnonzero(~np.isnan(v))
    if len(known) < max(least, 2):
        return z, rank
    x = v[known]
    d = x - np.median(x)
    bound = k * np.median(np.abs(d))
    d = np.clip(d, -bound, bound)
    if (s := d.std(ddof=1)) > 0:
        z[known] = (d - d.mean()) / s
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    rank[known] = (n.cumsum() - (n - 1) / 2)[at] / len(x)
    return z, rank


def sector_scores(df: DataFrame, columns: tuple[str, ...], k: float = 5.0, least: int = 10) -> DataFrame:
    """:func:`sector_normalised` of several columns in one Arrow pass by date and sector, where windows take four for each column, one with a sort of its own.

    What ``df`` carries beyond ``columns``, ``in_universe`` and the keys isn't pruned.
    """
    made = [f"{x}_{y}" for x in columns for y in ("zscore", "pctrank")]

    def fold(g: pa.Table) -> pa.Table:
        inside = pc.and_(g.column("in_universe"), pc.is_valid(g.column("sector"))).fill_null(False).to_numpy()
        found = [y for x in columns for y in scores(np.where(inside, g.column(x).to_numpy(), np.nan), k, least)]
        for name, y in zip(made, found, strict=True):
            g = g.append_column(name, pa.array(y, pa.float64(), from_pandas=True))
        return g

    return df.groupBy("date", "sector").applyInArrow(fold, T.StructType([*df.schema.fields, *[T.StructField(x, T.DoubleType()) for x in made]]))


def share_of(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))
