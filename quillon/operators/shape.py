"""Bar-shape and flow features of an instrument: transformed, enriched, pressure, order flow, liquidity, microstructure.

Prices that aren't positive count as missing. Instruments with fewer rows than
an operator's ``least_rows`` have no row in its result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.functions import columns as c
from quillon.operators.ewm import ewm

MIN_STD = 1e-12


def whole() -> WindowSpec:
    return Window.partitionBy("ticker")


def prepared(df: DataFrame, least_rows: int = 10) -> DataFrame:
    df = df.withColumns({x: c.positive(x) for x in ("open", "high", "low", "close")}).withColumn("_n", F.count("*").over(whole())).where(F.col("_n") >= least_rows)
    before = c.lag("close")
    df = df.withColumns({"_range": c.clip(F.col("high") - F.col("low"), c.EPS), "_ret": F.ln(F.col("close") / before), "_prev": before, "_dollars": F.col("close") * F.col("volume")})
    return df.withColumns({"_abs": F.abs("_ret"), "_clv": c.clip((F.col("close") - F.col("low")) / F.col("_range"), -1, 1)})


def transformed(df: DataFrame) -> DataFrame:
    """Log close and return, Garman-Klass variance, close location, robust volume and trade-size scores, fractional difference."""
    ratio = lambda a, b: c.log(c.div(a, b, MIN_STD), MIN_STD)
    df = df.withColumns({
        "log_close": c.log("close", MIN_STD), "garman_klass_var_1d": 0.5 * ratio("high", "low") ** 2 - (2 * math.log(2) - 1) * ratio("close", "open") ** 2,
        "clv": c.div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"), MIN_STD), "avg_trade_size": c.div("volume", "transactions", MIN_STD),
    })
    df = df.withColumn("log_return_1d", c.diff("log_close"))
    for x, out in (("volume", "volume_robust_z"), ("avg_trade_size", "trade_size_robust_z")):
        df = robust_z(df, x, out)
    return fractional_difference(df, "close", "close_frac_diff")


def robust_z(df: DataFrame, x: str, out: str, n: int = 63, least: int = 40) -> DataFrame:
    """Deviation from the rolling median in scaled median absolute deviations; a missing value in the frame hides them.

    Both medians come from one list of the frame's values.
    """
    own = c.frame(n)
    k = F.size("_all")
    middle = lambda xs: (F.get(xs, F.floor((k - 1) / 2).cast("int")) + F.get(xs, F.floor(k / 2).cast("int"))) / 2
    df = df.withColumns({"_all": F.sort_array(F.collect_list(x).over(own)), "_rows": F.count(F.lit(1)).over(own)})
    df = df.withColumn("_med", F.when(k >= least, middle(F.col("_all"))))
    away = df.withColumn("_away", F.sort_array(F.transform("_all", lambda v: F.abs(v - F.col("_med")))))
    mad = F.when((k == F.col("_rows")) & (k >= least), middle(F.col("_away")))
    return away.withColumn(out, c.div(F.col(x) - F.col("_med"), 1.4826 * mad, MIN_STD)).drop("_med", "_all", "_away", "_rows")


def binomial_weights(d: float, threshold: float) -> list[float]:
    out = [1.0]
    while abs(w := out[-1] * (d - len(out) + 1) / len(out)) >= threshold:
        out.append(w)
    return out


def fractional_difference(df: DataFrame, x: str, out: str, d: float = 0.4, threshold: float = 1e-3, least: int = 50) -> DataFrame:
    """Sum of binomial weights and lags; a series shorter than the weights has a value in its last row only."""
    weights = binomial_weights(d, threshold)
    terms = [c.lag(x, k) * w for k, w in enumerate(weights)]
    n, row = F.count("*").over(whole()), F.row_number().over(c.series())
    df = df.withColumns({"_whole": sum(terms[1:], terms[0]), "_part": sum(map(c.zero, terms[1:]), terms[0]), "_known": F.count(x).over(whole()), "_count": n, "_row": row})
    short = (F.col("_count") < len(weights)) & (F.col("_count") >= least) & (F.col("_row") == F.col("_count")) & (F.col("_known") == F.col("_count"))
    return df.withColumn(out, F.when(F.col("_count") >= len(weights), F.col("_whole")).when(short, F.col("_part"))).drop("_whole", "_part", "_known", "_count", "_row")


def sector_ranks(df: DataFrame, features: tuple[str, ...], sector: str = "sector") -> DataFrame:
    return df.withColumns({f"{x}_sector_rank": c.rank_share(x, "date", sector) for x in features})


def enriched(df: DataFrame) -> DataFrame:
    """Price structure, volume structure, momentum and reversion; RSI here starts at the first row, with losses floored."""
    df = prepared(df, 20)
    at_least = lambda x: c.clip(x, c.EPS)
    df = df.withColumns({
        "log_high_low_range": F.ln(F.col("high") / at_least("low")), "log_vwap_close": F.ln(F.col("vwap") / at_least("close")),
        "overnight_return": F.ln(F.col("open") / at_least("_prev")), "intraday_return": F.ln(F.col("close") / at_least("open")),
        "upper_shadow_pct": c.clip((F.col("high") - F.greatest("open", "close")) / F.col("_range"), 0, 1), "lower_shadow_pct": c.clip((F.least("open", "close") - F.col("low")) / F.col("_range"), 0, 1),
        "body_pct": c.clip(F.abs(F.col("close") - F.col("open")) / F.col("_range"), 0, 1), "high_close_pct": c.clip((F.col("high") - F.col("close")) / F.col("_range"), 0, 1),
        "_vcr": F.col("close") / at_least("vwap"), "log_dollar_volume": F.ln(c.clip("_dollars", 1)), "_tpd": F.col("transactions") / at_least("_dollars") * 1e6,
        "_gain": c.zero(c.clip(c.diff("close"), 0)), "_loss": c.zero(c.clip(-c.diff("close"), 0)),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev"))),
        "_sma20": c.mean("close", 20, 15), "_sma50": c.mean("close", 50, 35), "_bb": c.std("close", 20, 15),
    })
    df = ewm(df, {**{f"_{x}{n}": (f"_{x}", 1 / n, n) for n in (14, 5) for x in ("gain", "loss")}, "_ema10": ("close", 2 / 11, 7)})
    lower = F.col("_sma20") - 2 * F.col("_bb")
    return df.withColumns({
        "close_to_vwap_z20": c.z("_vcr", 20, 10, c.EPS), "dollar_volume_z20": c.z("_dollars", 20, 10, c.EPS), "relative_volume_20d": F.col("volume") / at_least(c.mean("volume", 20, 10)),
        "volume_return_corr_20d": c.correlation("volume", "_abs", 20, 15), "txn_per_dollar_z20": c.z("_tpd", 20, 10, c.EPS),
        **{f"ret_{n}d": c.total("_ret", n, m) for n, m in ((5, 3), (10, 7), (20, 15), (60, 40))},
        **{f"rsi_{n}": 100 - 100 / (1 + F.col(f"_gain{n}") / at_least(f"_loss{n}")) for n in (14, 5)},
        "price_vs_sma20": F.col("close") / at_least("_sma20") - 1, "price_vs_sma50": F.col("close") / at_least("_sma50") - 1, "price_vs_ema10": F.col("close") / at_least("_ema10") - 1,
        "sma20_slope_5": c.diff("_sma20", 5) / at_least(c.lag("_sma20", 5)), "bollinger_pct": c.clip((F.col("close") - lower) / at_least(4 * F.col("_bb")), -0.5, 1.5),
        "atr_14_pct": c.mean("_tr", 14) / at_least("close"),
    })


def eps_slope(x: str, n: int) -> Column:
    """Slope with a small constant in the denominator."""
    sxx = n * (n * n - 1) / 12
    return c.slope(x, n) * (sxx / (sxx + c.EPS))


def blend(**weighted: tuple[float, Column]) -> Column:
    """Weighted sum within [-1, 1], missing parts counting 0."""
    parts = [w * c.zero(x) for w, x in weighted.values()]
    return c.clip(sum(parts[1:], parts[0]), -1, 1)


def relative_to_deviation(x: str) -> Column:
    return F.tanh(F.col(x) / c.clip(c.std(x, 60, 20), c.EPS))


def pressure_velocity(df: DataFrame) -> DataFrame:
    """Buying and selling pressure, volume force, gaps, runs, velocity, accumulation and their blend."""
    df = prepared(df, 5).withColumns({"_i": c.numbered(), "clv": F.col("_clv")})
    df = df.withColumns({
        "buying_pressure": F.col("volume") * F.col("clv"), "selling_pressure": F.col("volume") * (1 - F.col("clv")), "volume_force": F.col("_ret") * F.col("volume"),
        "price_efficiency": c.clip(F.abs(F.col("close") - F.col("open")) / F.col("_range"), 0, 1), "gap_pct": (F.col("open") - F.col("_prev")) / c.clip("_prev", c.EPS),
        "volume_accel": F.col("volume") / c.clip(c.mean("volume", 20, 10), c.EPS), "dollar_volume_accel": F.col("_dollars") / c.clip(c.mean("_dollars", 20, 10), c.EPS),
        "ad_line": c.running(F.col("clv") * F.col("volume")),
        "_up": c.streak(F.col("_ret") > 0)[0], "_down": c.streak(F.col("_ret") < 0)[0],
    })
    df = df.withColumns({"consec_up_days": c.streak_length(F.col("_ret") > 0, "_up").cast("double"), "consec_down_days": c.streak_length(F.col("_ret") < 0, "_down").cast("double")})
    df = df.withColumns({
        "pressure_ratio": F.col("buying_pressure") / c.clip(F.col("buying_pressure") + F.col("selling_pressure"), c.EPS), "gap_direction": F.signum("gap_pct"),
        "run_length": F.col("consec_up_days") - F.col("consec_down_days"), "velocity_5d": eps_slope("close", 5), "velocity_20d": eps_slope("close", 20),
        "volume_force_5d": c.total("volume_force", 5, 3), "volume_force_20d": c.total("volume_force", 20, 10), "volume_accel_5d_avg": c.mean("volume_accel", 5, 3),
        "ad_line_slope_5d": eps_slope("ad_line", 5), "ad_line_slope_20d": eps_slope("ad_line", 20),
    })
    df = df.withColumns({"pressure_ratio_5d": c.mean("pressure_ratio", 5, 3), "pressure_ratio_20d": c.mean("pressure_ratio", 20, 10), "_force": relative_to_deviation("volume_force_20d"), "_ad": relative_to_deviation("ad_line_slope_20d")})
    return df.withColumn("pressure_velocity_composite", blend(pressure=(0.30, (F.col("pressure_ratio_20d") - 0.5) * 2), force=(0.25, F.col("_force")), run=(0.20, F.tanh(F.col("run_length") / 5)), pace=(0.10, F.tanh((F.col("volume_accel") - 1) / 2)), line=(0.15, F.col("_ad"))))


def order_flow(df: DataFrame) -> DataFrame:
    """Signed volume, its split into buys and sells, persistence of its sign, momentum, impact and divergence."""
    df = prepared(df).withColumn("ofi_proxy", F.col("_clv") * F.col("volume") * F.signum(c.zero("_ret")))
    buy = c.clip((F.col("_clv") + 1) / 2, 0, 1)
    df = df.withColumns({"_sign": F.signum("ofi_proxy"), "_buy": F.col("volume") * buy, "_sell": F.col("volume") * (1 - buy), "ofi_intensity": F.col("ofi_proxy") / c.clip(c.mean("volume", 20, 10), c.EPS), "price_impact_per_volume": F.col("_abs") / c.clip("volume", c.EPS) * 1e6})
    whole = c.clip(F.col("_buy") + F.col("_sell"), c.EPS)
    df = df.withColumns({
        "buy_volume_pct": F.col("_buy") / whole, "sell_volume_pct": F.col("_sell") / whole, "net_flow_ratio": (F.col("_buy") - F.col("_sell")) / whole,
        "ofi_proxy_5d": c.total("ofi_proxy", 5, 3), "ofi_proxy_20d": c.total("ofi_proxy", 20, 10), "price_impact_z20": c.z("price_impact_per_volume", 20, 10, c.EPS),
        "_row": F.row_number().over(c.series()), **{f"_s{n}": F.collect_list("_sign").over(c.frame(n)) for n in (5, 20)},
    })
    same = lambda n: F.when((F.col("_row") >= n) & F.col("_sign").isNotNull(), F.size(F.filter(f"_s{n}", lambda v: v == F.col("_sign"))) / F.size(f"_s{n}"))
    df = df.withColumns({"ofi_persistence_5d": same(5), "ofi_persistence_20d": same(20), "net_flow_ratio_5d": c.mean("net_flow_ratio", 5, 3), "net_flow_ratio_20d": c.mean("net_flow_ratio", 20, 10), "_ret5": c.total("_ret", 5, 3)})
    df = df.withColumns({"flow_momentum": c.diff("net_flow_ratio_5d", 5), "flow_volume_divergence": c.clip(F.tanh((F.col("net_flow_ratio_5d") - F.col("net_flow_ratio_20d")) * 5) - F.tanh(F.col("_ret5") * 10), -2, 2)})
    return df.withColumns({
        "flow_acceleration": c.diff("flow_momentum", 5),
        "ofi_composite": blend(intensity=(0.25, F.tanh("ofi_intensity")), flow=(0.25, c.clip("net_flow_ratio_20d", -1, 1)), persistence=(0.20, (F.coalesce("ofi_persistence_20d", F.lit(0.5)) - 0.5) * 2), momentum=(0.15, F.tanh(F.col("flow_momentum") * 5)), divergence=(0.15, F.tanh("flow_volume_divergence"))),
    })


def session_liquidity(df: DataFrame) -> DataFrame:
    """Spread, depth, stability, density, illiquidity, dry-ups. The liquidity score ranks over the whole history, later rows included."""
    df = prepared(df)
    at_least = lambda x: c.clip(x, c.EPS)
    df = df.withColumns({
        "spread_proxy": F.col("_range") / at_least("vwap"), "_v20": at_least(c.mean("volume", 20, 10)), "_vs": c.std("volume", 20, 10), "txn_density": F.col("transactions") / F.col("_range"),
        "illiquidity_amihud": F.col("_abs") / at_least("_dollars") * 1e8,
    })
    rank = lambda x: c.rank_share(x, "ticker")
    df = df.withColumns({
        "dollar_depth": F.col("_dollars") / at_least("spread_proxy"), "spread_proxy_5d": c.mean("spread_proxy", 5, 3), "spread_proxy_20d": c.mean("spread_proxy", 20, 10),
        "volume_stability": F.col("_vs") / F.col("_v20"), "txn_density_z20": c.z("txn_density", 20, 10, c.EPS), "illiquidity_amihud_5d": c.mean("illiquidity_amihud", 5, 3), "illiquidity_amihud_20d": c.mean("illiquidity_amihud", 20, 10),
        "liquidity_shock": c.flag(c.z("illiquidity_amihud", 20, 10, c.EPS) > 2), "dryup_score": 1 - c.clip(F.col("volume") / F.col("_v20"), 0, 3), "_dry": c.streak(F.col("volume") < F.col("_v20"))[0],
        "liquidity_score": c.clip(0.40 * (rank("volume") * 2 - 1) + 0.35 * ((1 - rank("spread_proxy")) * 2 - 1) + 0.25 * F.when(F.count("transactions").over(whole()) > 0, rank("transactions") * 2 - 1).otherwise(0.0), -1, 1),
    })
    df = df.withColumns({
        "dollar_depth_z20": c.z("dollar_depth", 20, 10, c.EPS), "spread_narrowing": (F.col("spread_proxy_20d") - F.col("spread_proxy")) / at_least("spread_proxy_20d"), "dryup_streak": c.streak_length(F.col("volume") < F.col("_v20"), "_dry").cast("double"),
        "liquidity_score_5d": c.mean("liquidity_score", 5, 3), "liquidity_score_20d": c.mean("liquidity_score", 20, 10),
    })
    df = df.withColumn("liquidity_trend", F.col("liquidity_score_5d") - F.col("liquidity_score_20d"))
    return df.withColumn("session_liquidity_composite", blend(level=(0.30, F.col("liquidity_score_20d")), trend=(0.25, F.tanh(F.col("liquidity_trend") * 5)), illiquid=(0.20, -F.tanh(F.col("illiquidity_amihud_20d") * 100)), depth=(0.15, F.tanh(F.col("dollar_depth_z20") / 2)), dry=(0.10, -F.tanh("dryup_score"))))


def volume_structure(df: DataFrame) -> DataFrame:
    """Deviation from the average price, stealth, trade size, concentration, smart money, absorption."""
    df = prepared(df)
    at_least = lambda x: c.clip(x, c.EPS)
    df = df.withColumns({
        "vwap_deviation": (F.col("close") - F.col("vwap")) / at_least("vwap"), "volume_vs_range": F.col("volume") / F.col("_range"), "txn_avg_size": F.col("volume") / c.clip("transactions", 1),
        "stealth_accumulation": c.clip(c.z("volume", 20, 10, c.EPS) - c.z("_abs", 20, 10, c.EPS), -5, 5), "volume_concentration": F.col("volume") / at_least(c.total("volume", 20, 10)),
        "smart_money_flow": F.col("_clv") * F.col("volume") * F.signum(c.zero("_ret")), "absorption_ratio": F.col("_dollars") / (at_least("_abs") * F.col("close") * 1e6),
        "volume_divergence": c.clip(c.mean("volume", 10, 5) / at_least(c.mean("volume", 20, 10)) - c.mean("_abs", 10, 5) / at_least(c.mean("_abs", 20, 10)), -3, 3),
    })
    df = df.withColumns({
        "vwap_deviation_5d": c.mean("vwap_deviation", 5, 3), "vwap_deviation_20d": c.mean("vwap_deviation", 20, 10), "volume_vs_range_z20": c.z("volume_vs_range", 20, 10, c.EPS), "stealth_score_5d": c.mean("stealth_accumulation", 5, 3),
        "stealth_score_20d": c.mean("stealth_accumulation", 20, 10), "txn_size_z20": c.z("txn_avg_size", 20, 10, c.EPS), "smart_money_flow_5d": c.total("smart_money_flow", 5, 3), "smart_money_flow_20d": c.total("smart_money_flow", 20, 10),
        "absorption_ratio_z20": c.z("absorption_ratio", 20, 10, c.EPS),
    })
    df = df.withColumns({"block_trade_proxy": c.flag(F.col("txn_size_z20") > 2), "_smart": F.tanh(c.zero("smart_money_flow_20d") / c.clip(c.std("smart_money_flow_20d", 60, 20), c.EPS))})
    return df.withColumn("microstructure_composite", F.when(F.col("_smart").isNotNull(), blend(stealth=(0.25, F.tanh(F.col("stealth_score_20d") / 2)), smart=(0.25, F.col("_smart")), divergence=(0.20, F.tanh("volume_divergence")), vwap=(0.15, F.tanh(F.col("vwap_deviation_20d") * 20)), absorption=(0.15, F.tanh(F.col("absorption_ratio_z20") / 2)))))
