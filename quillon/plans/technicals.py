"""Queries FT01-FT26: technical features over weekly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import technicals as t
from quillon.plans import sql as s
from quillon.sources.panels import bars


def rounded(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("ticker", "date"), digits: int = 6, places: dict[str, int] | None = None) -> DataFrame:
    """Doubles to so many places, for comparison across engines; a small offset settles exact ties, which the last bit would."""
    each = [(x, (places or {}).get(x, digits)) for x in columns]
    return df.select(*keys, *[(F.round(F.col(x).cast("double") + s.offset(n), n) + 0.0).alias(x) for x, n in each])


TR = f"greatest(high - low, abs(high - {s.lag('close')}), abs(low - {s.lag('close')}))"
CHG = lambda x, k=1: f"({s.div(x, s.lag(x, k))} - 1)"
LEVELS = {
    "ft01_cum_returns": (t.returns, [{f"cum_ret_{k}d": CHG("close", k) for k in (5, 10, 20, 60, 120)}]),
    "ft03_stochastic": (t.stochastic, [{"stoch_k_14": f"100 * {s.div(f'close - {s.low("low", 14)}', f'{s.high("high", 14)} - {s.low("low", 14)}')}"}, {"stoch_d_3": s.mean("stoch_k_14", 3)}]),
    "ft04_cci": (t.cci, [{"_tp": "(high + low + close) / 3"}, {"_m": s.mean("_tp", 20), "_all": f"list(_tp) OVER {s.frame(20)}"}, {"cci_20": s.div("_tp - _m", "0.015 * list_sum(list_transform(_all, lambda v: abs(v - _m))) / 20")}]),
    "ft06_ft07_ft08_moving_averages": (t.moving_averages, [
        {f"sma_{n}": s.mean("close", n) for n in (10, 20, 50, 200)},
        {"price_vs_sma10": f"{s.div('close', 'sma_10')} - 1", "price_vs_sma20": f"{s.div('close', 'sma_20')} - 1", "sma10_vs_sma20": f"{s.div('sma_10', 'sma_20')} - 1", "sma20_slope_5": CHG("sma_20", 5), "dist_to_sma_50": f"{s.div('close', 'sma_50')} - 1", "price_above_200dma": "CASE WHEN sma_200 IS NOT NULL THEN (close > sma_200)::INT END"},
    ]),
    "ft09_ft12_volume": (t.volume, [
        {"_i": f"row_number() OVER ({s.PO})", "_lv": s.log("volume"), "vol_avg_20": s.mean("volume", 20), "_ret": f"close - {s.lag('close')}"},
        {"volume_ratio_20": s.div("volume", "vol_avg_20"), "volume_change_pct_5d": CHG("volume", 5), "volume_trend_10d": s.slope("_lv", 10), "obv": f"sum(coalesce(sign(_ret), 0) * volume) OVER {s.ALL}", "adl": f"sum(coalesce({s.div('(close - low) - (high - close)', 'high - low')}, 0) * volume) OVER {s.ALL}"},
        {f"{x}_slope_5": s.div(f"{x} - {s.lag(x, 5)}", "vol_avg_20 + 1") for x in ("obv", "adl")},
    ]),
    "ft13_ft15_ft20_volatility": (t.volatility, [
        {"_tr": TR, "_r": CHG("close"), "bb_mid_20": s.mean("close", 20), "bb_std_20": s.std("close", 20)},
        {"atr_14": s.mean("_tr", 14), **{f"realized_vol_{n}": f"{s.std('_r', n)} * sqrt(252)" for n in (10, 20, 60)}, "bb_upper_20": "bb_mid_20 + 2 * bb_std_20", "bb_lower_20": "bb_mid_20 - 2 * bb_std_20"},
        {"atr_pct_14": s.div("atr_14", "close"), "bb_width_20": s.div("bb_upper_20 - bb_lower_20", "bb_mid_20"), "bb_pos_20": s.div("close - bb_lower_20", "bb_upper_20 - bb_lower_20"), "vol_term_structure": s.div("realized_vol_10", "realized_vol_60"), "vol_term_structure_20_60": s.div("realized_vol_20", "realized_vol_60")},
    ]),
    "ft16_ft17_ft24_extremes": (t.extremes, [
        {"high_20": s.high("high", 20), "low_20": s.low("low", 20), "_h60": s.high("high", 60), "_l60": s.low("low", 60)},
        {"dist_from_20d_high": f"{s.div('close', 'high_20')} - 1", "dist_from_20d_low": f"{s.div('close', 'low_20')} - 1", "breakout_20d_high_flag": f"(close > {s.lag('high_20')})::INT", "breakdown_20d_low_flag": f"(close < {s.lag('low_20')})::INT", "channel_pos_60d": s.div("close - _l60", "_h60 - _l60"), "dist_from_60d_high": f"{s.div('close', '_h60')} - 1", "dist_from_60d_low": f"{s.div('close', '_l60')} - 1"},
    ]),
    "ft19_ft21_ft23_momentum": (t.momentum, [
        {"_i": f"row_number() OVER ({s.PO})", "_tp": "(high + low + close) / 3", "_dc": f"coalesce(sign(close - {s.lag('close')}), 0) * volume", "_c5": CHG("close", 5), "_c20": CHG("close", 20)},
        {"_obv": f"sum(_dc) OVER {s.ALL}", "_up": f"CASE WHEN _tp - {s.lag('_tp')} > 0 THEN _tp * volume ELSE 0 END", "_down": f"CASE WHEN _tp - {s.lag('_tp')} < 0 THEN _tp * volume ELSE 0 END"},
        {"_sc": s.slope("close", 20), "_so": s.slope("_obv", 20)},
        {"mfi_14": f"100 - 100 / (1 + {s.div(s.total('_up', 14), s.total('_down', 14))})", "mom_accel_5d": f"_c5 - {s.lag('_c5', 5)}", "mom_accel_20d": f"_c20 - {s.lag('_c20', 20)}", "vol_price_divergence_20d": "sign(_sc) * ln(1 + abs(_sc)) - sign(_so) * ln(1 + abs(_so))", "trend_r2_20d": s.r2("close", 20), "trend_r2_60d": s.r2("close", 60)},
    ]),
    "ft25_vwap": (t.vwap_distance, [{"vwap_distance": f"{s.div('close', 'vwap')} - 1"}, {"vwap_z_20d": s.z("vwap_distance", 20)}]),
    "ft02_rsi": (t.relative_strength, [
        {"_d": f"close - {s.lag('close')}"}, {"_gain": s.clip("_d", 0), "_loss": s.clip("-_d", 0)},
        {f"_{x}{n}": s.ewm(f"_{x}", 1 / n, n) for n in (14, 21) for x in ("gain", "loss")}, {f"rsi_{n}": f"100 - 100 / (1 + {s.div(f'_gain{n}', f'_loss{n}')})" for n in (14, 21)},
    ]),
    "ft05_macd_ema": (t.macd, [
        {"ema_10": s.ewm("close", 2 / 11, 10), "ema_12": s.ewm("close", 2 / 13, 12), "ema_20": s.ewm("close", 2 / 21, 20), "ema_26": s.ewm("close", 2 / 27, 26), "ema_200": s.ewm("close", 2 / 201, 200)},
        {"macd_12_26": "ema_12 - ema_26"}, {"macd_signal_9": s.ewm("macd_12_26", 0.2, 9)}, {"macd_hist": "macd_12_26 - macd_signal_9", "ema10_slope_5": CHG("ema_10", 5), "dist_to_ema_200": f"{s.div('close', 'ema_200')} - 1"},
    ]),
    "ft18_adx": (t.directional, [
        {"_u": f"high - {s.lag('high')}", "_d": f"{s.lag('low')} - low", "_tr": TR}, {"_up": "coalesce(greatest(_u, 0), 0)", "_dn": "coalesce(greatest(_d, 0), 0)"},
        {"_pdm": "CASE WHEN _up > _dn THEN _up ELSE 0 END::DOUBLE"}, {"_mdm": "CASE WHEN _dn > _pdm THEN _dn ELSE 0 END::DOUBLE"},
        {"_atr": s.ewm("_tr", 1 / 14, 14), "_ps": s.ewm("_pdm", 1 / 14, 14), "_ms": s.ewm("_mdm", 1 / 14, 14)}, {"plus_di_14": f"100 * {s.div('_ps', '_atr')}", "minus_di_14": f"100 * {s.div('_ms', '_atr')}"},
        {"_dx": f"100 * {s.div('abs(plus_di_14 - minus_di_14)', 'plus_di_14 + minus_di_14')}"}, {"adx_14": s.ewm("_dx", 1 / 14, 14), "di_spread_14": "plus_di_14 - minus_di_14"},
    ]),
    "ft26_cross_section": (t.cross_section, [
        {"ret_1": CHG("close"), "mom_60": CHG("close", 60)}, {"vol_20": s.std("ret_1", 20)},
        {k: v for x in t.RANKED for k, v in {f"{x}_rel_to_sector": f"{x} - avg({x}) OVER (PARTITION BY date, sector)", f"{x}_sector_z": s.group_z(x, "date", "sector"), f"cs_rank_{x}": s.rank(x, "date", descending=True), f"sector_rank_{x}": s.rank(x, "date", "sector", descending=True), f"industry_rank_{x}": s.rank(x, "date", "industry", descending=True)}.items()},
    ]),
}
SECTORAL = {"ft26_cross_section"}


def outputs(levels: list[dict[str, str]]) -> list[str]:
    return [x for level in levels for x in level if not x.startswith("_")]


def query(operator, levels, sectoral: bool):
    return lambda spark, sf_dir: rounded(operator(bars(spark, sf_dir, sectoral)), outputs(levels))


QUERIES = {k: query(f, levels, k in SECTORAL) for k, (f, levels) in LEVELS.items()}
ORACLES = {k: s.chain(s.BARS, *levels, start="sbars" if k in SECTORAL else "bars") for k, (_, levels) in LEVELS.items()}
