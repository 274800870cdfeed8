"""Ticks to minutes to sessions: trade pressure, quote proxies, streaks, session curves and risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.functions import columns as c


def day(*order: str) -> WindowSpec:
    """The rows of a session; in the order of trades or minutes, if asked for."""
    w = Window.partitionBy("ticker", "date")
    return w.orderBy(*order) if order else w


def by_tick() -> WindowSpec:
    return day("ts", "event_id")


def by_minute() -> WindowSpec:
    return day("minute")


EPS = 1e-9


def share(a: Column | str, b: Column | str) -> Column:
    return c.zero(c.clip(c.div(a, b), 0, 1))


def tick_flags(ticks: DataFrame) -> DataFrame:
    """Tick rule: the last non-zero price change signs a trade; moves beyond five basis points go through the quote."""
    step = c.diff("trade_price", 1, by_tick())
    df = ticks.withColumns({"_step": F.nullif(F.signum(step), F.lit(0.0)), "_pct": c.zero(c.div(step, c.lag("trade_price", 1, by_tick())))})
    df = df.withColumn("tick_sign", F.coalesce(F.last("_step", True).over(by_tick().rowsBetween(*c.ALL)), F.lit(0.0)))
    buy, sell = F.col("tick_sign") > 0, F.col("tick_sign") < 0
    return df.withColumns({"aggressive_buy": c.flag(buy), "aggressive_sell": c.flag(sell), "through_ask": c.flag((F.col("_pct") > 0.0005) & buy), "through_bid": c.flag((F.col("_pct") < -0.0005) & sell)})


SIDES = ("aggressive_buy", "aggressive_sell", "through_ask", "through_bid")


def trade_minutes(ticks: DataFrame) -> DataFrame:
    """Minute bars of trades with notional and count by side, and shares of the minute."""
    order = F.struct("ts", "event_id")
    df = tick_flags(ticks).groupBy("ticker", "date", "minute").agg(
        F.sum("trade_notional").alias("trade_notional"), F.sum("trade_size").alias("trade_size"), F.count("*").alias("trade_count"),
        *[F.sum(F.col("trade_notional") * F.col(x)).alias(f"{x}_notional") for x in SIDES], *[F.sum(x).alias(f"{x}_trades") for x in SIDES],
        F.min_by("trade_price", order).alias("minute_open"), F.max_by("trade_price", order).alias("minute_close"), F.max("trade_price").alias("minute_high"), F.min("trade_price").alias("minute_low"),
    )
    return with_shares(df)


def with_shares(df: DataFrame) -> DataFrame:
    buy, sell = F.col("aggressive_buy_notional"), F.col("aggressive_sell_notional")
    net = c.zero(c.clip((buy - sell) / (c.nonzero(buy + sell) + EPS), -1, 1))
    return df.withColumns({**{f"{x}_share": share(f"{x}_notional", "trade_notional") for x in SIDES}, "net_aggression": net})


def quote_proxy(minutes: DataFrame) -> DataFrame:
    """Quotes as trades imply them: direction of the close, imbalance from net aggression."""
    df = minutes.withColumns({"price_step": c.zero(c.diff("minute_close", 1, by_minute())), "quote_imbalance": c.clip("net_aggression", -1, 1)})
    up, down = c.flag(F.col("price_step") > 0), c.flag(F.col("price_step") < 0)
    return df.select("ticker", "date", "minute", F.col("minute_close").alias("mid_price"), "quote_imbalance", F.col("trade_count").alias("quote_updates"), up.alias("bid_up"), down.alias("bid_down"), up.alias("ask_up"), down.alias("ask_down"), c.zero(c.diff("quote_imbalance", 1, by_minute())).alias("imbalance_step"))


def longest_streak(df: DataFrame, condition: Column, out: str) -> DataFrame:
    """Per (ticker, date), the most minutes in a row that meet the condition."""
    hit = F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)
    df = df.withColumn("_hit", hit).withColumn("_g", F.sum(1 - F.col("_hit")).over(by_minute().rowsBetween(*c.ALL)))
    return df.groupBy("ticker", "date", "_g").agg(F.sum("_hit").alias("n")).groupBy("ticker", "date").agg(F.max("n").alias(out))


def daily_pressure(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes and trades by minute, outer-joined, to one row per day with long and short base scores."""
    both = quotes.join(trades, ["ticker", "date", "minute"], "outer")
    zeros = ["trade_notional", "trade_size", "trade_count", *[f"{x}_{k}" for x in SIDES for k in ("notional", "trades", "share")], "net_aggression", "quote_updates", "bid_up", "bid_down", "ask_up", "ask_down", "imbalance_step"]
    both = both.na.fill(0, zeros)
    pulse = lambda side, through, step, lean: c.clip(0.55 * F.col(f"aggressive_{side}_share") + 0.20 * F.col(f"through_{through}_share") + 0.15 * F.col(step) + 0.10 * c.clip(lean, 0), 0, 1)
    both = both.withColumns({"long_pulse": pulse("buy", "ask", "bid_up", F.col("quote_imbalance")), "short_pulse": pulse("sell", "bid", "bid_down", -F.col("quote_imbalance"))})
    sums = ["quote_updates", "trade_count", "trade_notional", "trade_size", *[f"{x}_notional" for x in SIDES]]
    daily = both.groupBy("ticker", "date").agg(
        F.count("*").alias("minute_rows"), *[F.sum(x).alias(x) for x in sums], *[F.avg(f"{x}_share").alias(f"{x}_share_mean") for x in SIDES], F.avg("net_aggression").alias("net_aggression_mean"),
        *[F.avg(x).alias(f"{x}_share") for x in ("bid_up", "bid_down", "ask_up", "ask_down")], F.avg("quote_imbalance").alias("quote_imbalance_mean"), F.max_by("quote_imbalance", "minute").alias("quote_imbalance_close"),
        *[F.avg(f"{x}_pulse").alias(f"{x}_pulse_mean") for x in ("long", "short")], *[F.avg(c.flag(F.col(f"{x}_pulse") >= 0.55)).alias(f"{x}_pressure_minutes") for x in ("long", "short")],
    )
    daily = with_shares(daily)
    for x in ("long", "short"):
        daily = daily.join(longest_streak(both, F.col(f"{x}_pulse") >= 0.55, f"{x}_max_streak"), ["ticker", "date"], "left")
        daily = daily.withColumn(f"{x}_streak_ratio", share(f"{x}_max_streak", "minute_rows"))
    lean = F.col("quote_imbalance_mean")
    base = lambda x, side, through, way, tilt: c.clip(0.40 * F.col(f"aggressive_{side}_share") + 0.20 * F.col(f"through_{through}_share") + 0.20 * F.col(f"{x}_pressure_minutes") + 0.10 * F.col(f"{x}_streak_ratio") + 0.10 * c.clip(((F.col(f"bid_{way}_share") + F.col(f"ask_{way}_share")) / 2 + c.clip((tilt + 1) / 2, 0, 1)) / 2, 0, 1), 0, 1)
    return daily.withColumns({"pressure_velocity_long_base": base("long", "buy", "ask", "up", lean), "pressure_velocity_short_base": base("short", "sell", "bid", "down", -lean)})


def session_minutes(ticks: DataFrame, start: int = 570, end: int = 960, lookback: int = 20, least: int = 5, slot: int = 1) -> DataFrame:
    """Minute bars with cumulative shares of the session, and their deviation from the same minute of past sessions.

    ``slot`` widens "the same minute" to so many minutes, for sparse sessions.
    """
    order = F.struct("ts", "event_id")
    moved = F.when(F.coalesce(c.diff("trade_price", 1, by_tick()) == 0, F.lit(False)), 0.0).otherwise(1.0)
    m = ticks.withColumn("_moved", moved).groupBy("ticker", "date", "minute").agg(
        F.min_by("trade_price", order).alias("open"), F.max("trade_price").alias("high"), F.min("trade_price").alias("low"), F.max_by("trade_price", order).alias("close"),
        F.sum("trade_notional").alias("notional"), F.sum("trade_size").alias("size"), F.count("*").cast("double").alias("trades"), F.sum("_moved").alias("moves"),
        F.sum(F.col("trade_notional") * F.col("off_exchange_flag")).alias("off_notional"), F.sum("off_exchange_flag").alias("off_trades"),
    )
    middle = F.coalesce(c.div("notional", "size"), "close")
    place = F.hour("minute") * 60 + F.minute("minute") - start
    m = m.withColumns({"range_bps": c.zero(c.div(F.col("high") - F.col("low"), middle) * 10000), "close_to_open_bps": c.zero(c.div(F.col("close") - F.col("open"), "open") * 10000), "update_proxy": F.col("trades") + F.col("moves"), "minute_of_session": F.floor(F.least(F.greatest(place, F.lit(0)), F.lit(end - start)) / slot).cast("int")})
    run = by_minute().rowsBetween(*c.ALL)
    m = m.withColumns({
        **{f"cum_{x}_share": share(F.sum(x).over(run), F.sum(y).over(day())) for x, y in (("notional", "notional"), ("trades", "trades"), ("off_notional", "notional"), ("off_trades", "trades"))},
        **{f"hhi_{x}": share(x, F.sum(x).over(day())) ** 2 for x in ("notional", "trades")}, "idle_gap": c.clip(c.zero(c.diff("minute_of_session", 1, by_minute())) - 1, 0),
    })
    past = Window.partitionBy("ticker", "minute_of_session").orderBy("date", "minute")
    for x in ("cum_notional_share", "cum_off_notional_share", "range_bps", "update_proxy"):
        m = m.withColumn(f"{x}_dev", F.col(x) - c.rolling(F.avg, x, lookback, max(least, min(lookback, 20)), 1, past))
    return m.withColumns({"curve_deficit": c.clip(-F.col("cum_notional_share_dev"), 0), "curve_surplus": c.clip("cum_notional_share_dev", 0), "spread_widening": c.clip("range_bps_dev", 0), "update_shortfall": c.clip(-F.col("update_proxy_dev"), 0), "off_shift": F.abs("cum_off_notional_share_dev")})


PARTS = {"open30": lambda m: m <= 30, "midday": lambda m: m.between(120, 240), "late": lambda m: m >= 300}


def session_summary(m: DataFrame) -> DataFrame:
    """A row per session: totals, concentration, curve errors, means over parts of the day."""
    at = F.col("minute_of_session")
    parts = [F.avg(F.when(f(at), F.col(x))).alias(f"shadow_{y}_{k}") for x, y in (("curve_deficit", "curve"), ("spread_widening", "spread"), ("update_shortfall", "update"), ("off_shift", "off_shift")) for k, f in PARTS.items()]
    s = m.groupBy("ticker", "date").agg(
        F.count("*").alias("shadow_session_minutes"), *[F.sum(x).alias(f"shadow_session_{x}") for x in ("notional", "trades", "off_notional", "off_trades")], F.avg("idle_gap").alias("shadow_session_idle_gap_mean"), F.max("idle_gap").alias("shadow_session_idle_gap_max"),
        F.sum("hhi_notional").alias("shadow_session_hhi_notional"), F.sum("hhi_trades").alias("shadow_session_hhi_trade"), F.avg("range_bps").alias("shadow_session_range_bps_mean"), F.max("range_bps").alias("shadow_session_range_bps_max"), F.avg("update_proxy").alias("shadow_update_proxy_mean"), F.max("update_proxy").alias("shadow_update_proxy_max"),
        F.avg(F.abs("cum_notional_share_dev")).alias("shadow_curve_mae"), F.sqrt(F.avg(F.col("cum_notional_share_dev") ** 2)).alias("shadow_curve_rmse"), F.max("curve_deficit").alias("shadow_curve_peak_deficit"), F.max("curve_surplus").alias("shadow_curve_peak_surplus"),
        *[f(x).alias(f"shadow_{y}_{k}") for x, y in (("spread_widening", "spread"), ("update_shortfall", "update_shortfall"), ("off_shift", "off_shift")) for k, f in (("mean", F.avg), ("max", F.max))], *parts, F.avg("close_to_open_bps").alias("shadow_close_to_open_bps_mean"),
    )
    return s.withColumns({"shadow_session_off_share": share("shadow_session_off_notional", "shadow_session_notional"), "shadow_session_off_trade_share": share("shadow_session_off_trades", "shadow_session_trades")})


SCORED = ("shadow_curve_mae", "shadow_curve_rmse", "shadow_curve_peak_deficit", "shadow_spread_mean", "shadow_spread_max", "shadow_update_shortfall_mean", "shadow_update_shortfall_max", "shadow_off_shift_mean", "shadow_off_shift_max", "shadow_session_idle_gap_max", "shadow_session_hhi_notional")


def session_risk(s: DataFrame) -> DataFrame:
    """Logistic risk scores from positive z-scores by date; the last term of the final score is unbounded, so it is clipped."""
    s = s.withColumns({f"{x}_cs_z": c.zero(c.clip(c.group_z(x, "date"), -10, 10)) for x in SCORED})
    pos = lambda x, sign=1: c.clip(sign * F.col(f"shadow_{x}_cs_z"), 0)
    logistic = lambda x: 1 / (1 + F.exp(-x))
    drought = 0.35 * pos("curve_peak_deficit") + 0.20 * pos("curve_mae") + 0.20 * pos("spread_mean") + 0.15 * pos("off_shift_max") + 0.10 * pos("session_idle_gap_max") + 0.05 * pos("update_shortfall_mean", -1)
    s = s.withColumns({"shadow_liquidity_drought_risk": logistic(drought), "shadow_spread_widening_risk": logistic(0.60 * pos("spread_mean") + 0.40 * pos("spread_max")), "shadow_quote_update_intensity_risk": logistic(0.60 * pos("update_shortfall_mean") + 0.40 * pos("update_shortfall_max"))})
    score = 0.40 * F.col("shadow_liquidity_drought_risk") + 0.25 * F.col("shadow_spread_widening_risk") + 0.20 * F.col("shadow_quote_update_intensity_risk") + 0.15 * pos("off_shift_max")
    return s.withColumn("shadow_liquidity_shadow_score", c.clip(score, 0, 1))
