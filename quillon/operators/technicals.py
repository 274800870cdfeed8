"""Technical features of a bar panel, by instrument and then by cross-section.

Each function takes bars (``ticker, date, open, high, low, close, volume, ...``)
and adds columns. Features that build on windowed ones stand in a later level;
all levels keep one partitioning by ticker, so there is one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import columns as c
from quillon.operators.ewm import ewm


def returns(df: DataFrame) -> DataFrame:
    """Cumulative returns over 5 to 120 rows."""
    return df.withColumns({f"cum_ret_{k}d": c.change("close", k) for k in (5, 10, 20, 60, 120)})


def stochastic(df: DataFrame) -> DataFrame:
    lo, hi = c.low("low", 14), c.high("high", 14)
    df = df.withColumns({"stoch_k_14": 100 * c.div(F.col("close") - lo, hi - lo)})
    return df.withColumns({"stoch_d_3": c.mean("stoch_k_14", 3)})


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    """Typical price against its mean, in mean absolute deviations of the frame."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    own = c.frame(n)
    df = df.withColumns({"_m": c.mean("_tp", n), "_all": F.collect_list("_tp").over(own)})
    away = F.aggregate("_all", F.lit(0.0), lambda s, v: s + F.abs(v - F.col("_m"))) / n
    return df.withColumn(f"cci_{n}", c.div(F.col("_tp") - F.col("_m"), 0.015 * away)).drop("_all")


def moving_averages(df: DataFrame) -> DataFrame:
    df = df.withColumns({f"sma_{n}": c.mean("close", n) for n in (10, 20, 50, 200)})
    return df.withColumns({
        "price_vs_sma10": c.div("close", "sma_10") - 1, "price_vs_sma20": c.div("close", "sma_20") - 1, "sma10_vs_sma20": c.div("sma_10", "sma_20") - 1,
        "sma20_slope_5": c.change("sma_20", 5), "dist_to_sma_50": c.div("close", "sma_50") - 1,
        "price_above_200dma": F.when(F.col("sma_200").isNotNull(), (F.col("close") > F.col("sma_200")).cast("double")),
    })


def volume(df: DataFrame) -> DataFrame:
    df = df.withColumns({"_i": c.numbered(), "_lv": c.log("volume"), "vol_avg_20": c.mean("volume", 20), "_ret": c.diff("close")})
    df = df.withColumns({
        "volume_ratio_20": c.div("volume", "vol_avg_20"), "volume_change_pct_5d": c.change("volume", 5), "volume_trend_10d": c.slope("_lv", 10),
        "obv": c.running(c.zero(F.signum("_ret")) * F.col("volume")),
        "adl": c.running(c.zero(c.div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))) * F.col("volume")),
    })
    return df.withColumns({f"{x}_slope_5": c.div(c.diff(x, 5), F.col("vol_avg_20") + 1) for x in ("obv", "adl")})


def true_range() -> Column:
    before = c.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def volatility(df: DataFrame) -> DataFrame:
    """True range, Bollinger bands, realized volatility and its term structure."""
    df = df.withColumns({"_tr": true_range(), "_r": c.change("close"), "bb_mid_20": c.mean("close", 20), "bb_std_20": c.std("close", 20)})
    df = df.withColumns({"atr_14": c.mean("_tr", 14), **{f"realized_vol_{n}": c.std("_r", n) * F.sqrt(F.lit(252.0)) for n in (10, 20, 60)}, "bb_upper_20": F.col("bb_mid_20") + 2 * F.col("bb_std_20"), "bb_lower_20": F.col("bb_mid_20") - 2 * F.col("bb_std_20")})
    return df.withColumns({
        "atr_pct_14": c.div("atr_14", "close"), "bb_width_20": c.div(F.col("bb_upper_20") - F.col("bb_lower_20"), "bb_mid_20"),
        "bb_pos_20": c.div(F.col("close") - F.col("bb_lower_20"), F.col("bb_upper_20") - F.col("bb_lower_20")),
        "vol_term_structure": c.div("realized_vol_10", "realized_vol_60"), "vol_term_structure_20_60": c.div("realized_vol_20", "realized_vol_60"),
    })


def extremes(df: DataFrame) -> DataFrame:
    """Highs and lows, breakouts beyond the ones before this row, place in the 60-row channel."""
    df = df.withColumns({"high_20": c.high("high", 20), "low_20": c.low("low", 20), "_h60": c.high("high", 60), "_l60": c.low("low", 60)})
    before_h, before_l = c.lag("high_20"), c.lag("low_20")
    return df.withColumns({
        "dist_from_20d_high": c.div("close", "high_20") - 1, "dist_from_20d_low": c.div("close", "low_20") - 1,
        "breakout_20d_high_flag": (F.col("close") > before_h).cast("double"), "breakdown_20d_low_flag": (F.col("close") < before_l).cast("double"),
        "channel_pos_60d": c.div(F.col("close") - F.col("_l60"), F.col("_h60") - F.col("_l60")),
        "dist_from_60d_high": c.div("close", "_h60") - 1, "dist_from_60d_low": c.div("close", "_l60") - 1,
    })


def momentum(df: DataFrame) -> DataFrame:
    """Money flow, acceleration, trend fit and the divergence of price and volume trends."""
    df = df.withColumns({"_i": c.numbered(), "_tp": (F.col("high") + F.col("low") + F.col("close")) / 3, "_obv": c.running(c.zero(F.signum(c.diff("close"))) * F.col("volume")), "_c5": c.change("close", 5), "_c20": c.change("close", 20)})
    df = df.withColumns({"_up": F.when(c.diff("_tp") > 0, F.col("_tp") * F.col("volume")).otherwise(0.0), "_down": F.when(c.diff("_tp") < 0, F.col("_tp") * F.col("volume")).otherwise(0.0), "_sc": c.slope("close", 20), "_so": c.slope("_obv", 20)})
    squash = lambda x: F.signum(x) * F.log1p(F.abs(F.col(x)))
    ratio = c.div(c.total("_up", 14), c.total("_down", 14))
    return df.withColumns({
        "mfi_14": 100 - 100 / (1 + ratio), "mom_accel_5d": c.diff("_c5", 5), "mom_accel_20d": c.diff("_c20", 20),
        "vol_price_divergence_20d": squash("_sc") - squash("_so"), "trend_r2_20d": c.r_squared("close", 20), "trend_r2_60d": c.r_squared("close", 60),
    })


def vwap_distance(df: DataFrame) -> DataFrame:
    df = df.withColumn("vwap_distance", c.div("close", "vwap") - 1)
    return df.withColumn("vwap_z_20d", c.z("vwap_distance", 20))


def relative_strength(df: DataFrame) -> DataFrame:
    """Wilder's RSI: the first gain is missing, so that the recursion starts at the second row; no loss gives NULL."""
    d = c.diff("close")
    df = df.withColumns({"_gain": c.clip(d, 0), "_loss": c.clip(-d, 0)})
    df = ewm(df, {f"_{x}{n}": (f"_{x}", 1 / n, n) for n in (14, 21) for x in ("gain", "loss")})
    return df.withColumns({f"rsi_{n}": 100 - 100 / (1 + c.div(f"_gain{n}", f"_loss{n}")) for n in (14, 21)})


def macd(df: DataFrame) -> DataFrame:
    df = ewm(df, {"ema_10": ("close", 2 / 11, 10), "ema_12": ("close", 2 / 13, 12), "ema_20": ("close", 2 / 21, 20), "ema_26": ("close", 2 / 27, 26), "ema_200": ("close", 2 / 201, 200)})
    df = df.withColumn("macd_12_26", F.col("ema_12") - F.col("ema_26"))
    df = ewm(df, {"macd_signal_9": ("macd_12_26", 0.2, 9)})
    return df.withColumns({"macd_hist": F.col("macd_12_26") - F.col("macd_signal_9"), "ema10_slope_5": c.change("ema_10", 5), "dist_to_ema_200": c.div("close", "ema_200") - 1})


def directional(df: DataFrame) -> DataFrame:
    """Wilder's directional movement. On a tie the plus side is zeroed first, so that the minus side stays."""
    up, down = c.diff("high"), -c.diff("low")
    df = df.withColumns({"_up": F.coalesce(c.clip(up, 0), F.lit(0.0)), "_dn": F.coalesce(c.clip(down, 0), F.lit(0.0)), "_tr": true_range()})
    df = df.withColumn("_pdm", F.when(F.col("_up") > F.col("_dn"), F.col("_up")).otherwise(0.0))
    df = df.withColumn("_mdm", F.when(F.col("_dn") > F.col("_pdm"), F.col("_dn")).otherwise(0.0))
    df = ewm(df, {"_atr": ("_tr", 1 / 14, 14), "_ps": ("_pdm", 1 / 14, 14), "_ms": ("_mdm", 1 / 14, 14)})
    df = df.withColumns({"plus_di_14": 100 * c.div("_ps", "_atr"), "minus_di_14": 100 * c.div("_ms", "_atr")})
    df = df.withColumn("_dx", 100 * c.div(F.abs(F.col("plus_di_14") - F.col("minus_di_14")), F.col("plus_di_14") + F.col("minus_di_14")))
    df = ewm(df, {"adx_14": ("_dx", 1 / 14, 14)})
    return df.withColumn("di_spread_14", F.col("plus_di_14") - F.col("minus_di_14"))


RANKED = ("ret_1", "vol_20", "mom_60")


def cross_section(df: DataFrame) -> DataFrame:
    """Against the sector on each date: difference, z-score, descending percentile ranks by date, sector and industry."""
    df = df.withColumns({"ret_1": c.change("close"), "mom_60": c.change("close", 60)})
    df = df.withColumn("vol_20", c.std("ret_1", 20))
    w = c.Window.partitionBy("date", "sector")
    out = {}
    for x in RANKED:
        out |= {
            f"{x}_rel_to_sector": F.when(F.col("sector").isNotNull(), F.col(x) - F.avg(x).over(w)), f"{x}_sector_z": F.when(F.col("sector").isNotNull(), c.group_z(x, "date", "sector")),
            f"cs_rank_{x}": c.rank_share(x, "date", descending=True), f"sector_rank_{x}": c.rank_share(x, "date", "sector", descending=True), f"industry_rank_{x}": c.rank_share(x, "date", "industry", descending=True),
        }
    return df.withColumns(out)
