"""Queries FP, FE, FV, FO, FL, FM: bar-shape and flow features over weekly bars."""

from __future__ import annotations

from quillon.operators import shape
from quillon.plans import sql as s
from quillon.plans.technicals import outputs, rounded
from quillon.sources.panels import bars

E9 = 1e-9
AL = lambda x: s.clip(x, E9)
PREPARED = [
    {"_range": AL("high - low"), "_prev": s.lag("close"), "_dollars": "close * volume"},
    {"_ret": "ln(close / _prev)", "_clv": s.clip("(close - low) / _range", -1, 1)},
    {"_abs": "abs(_ret)"},
]
WEIGHTS = shape.binomial_weights(0.4, 1e-3)


def ROBUST(x: str, out: str, k: int) -> list[dict[str, str]]:
    w = s.frame(63)
    return [
        {f"_m{k}": f"CASE WHEN count({x}) OVER {w} >= 40 THEN median({x}) OVER {w} END", f"_a{k}": f"list({x}) OVER {w}"},
        {f"_d{k}": f"CASE WHEN len(_a{k}) >= 40 THEN list_aggregate(list_transform(_a{k}, lambda v: abs(v - _m{k})), 'median') END"},
        {out: s.div(f"{x} - _m{k}", f"1.4826 * _d{k}", 1e-12)},
    ]


def RUN(condition: str, name: str) -> list[dict[str, str]]:
    hit = f"CASE WHEN {condition} THEN 1 ELSE 0 END"
    return [{f"_g{name}": f"sum(1 - ({hit})) OVER {s.ALL}"}, {name: f"sum({hit}) OVER (PARTITION BY ticker, _g{name} ORDER BY date)"}]


def EPS_SLOPE(x: str, n: int) -> str:
    sxx = n * (n * n - 1) / 12
    return f"{s.slope(x, n)} * {sxx / (sxx + E9)!r}::DOUBLE"


def DEV(x: str) -> str:
    return f"tanh({x} / {AL(s.std(x, 60, 20))})"


def BLEND(*parts: tuple[float, str]) -> str:
    return s.clip(" + ".join(f"{w} * {s.zero(x)}" for w, x in parts), -1, 1)


TRUE_RANGE = "greatest(high - low, abs(high - _prev), abs(low - _prev))"
LEVELS = {
    "fp01_fp06_w08_w25_transformed": (shape.transformed, [
        {"log_close": s.log("close", 1e-12), "garman_klass_var_1d": f"0.5 * {s.log(s.div('high', 'low', 1e-12), 1e-12)} ** 2 - (2 * ln(2) - 1) * {s.log(s.div('close', 'open', 1e-12), 1e-12)} ** 2", "clv": s.div("(close - low) - (high - close)", "high - low", 1e-12), "avg_trade_size": s.div("volume", "transactions", 1e-12)},
        {"log_return_1d": f"log_close - {s.lag('log_close')}"},
        *ROBUST("volume", "volume_robust_z", 1), *ROBUST("avg_trade_size", "trade_size_robust_z", 2),
        {"close_frac_diff": f"CASE WHEN count(*) OVER (PARTITION BY ticker) >= {len(WEIGHTS)} THEN " + " + ".join(f"{w!r}::DOUBLE * lag(close, {k}) OVER ({s.PO})" for k, w in enumerate(WEIGHTS)) + f" WHEN count(*) OVER (PARTITION BY ticker) >= 50 AND row_number() OVER ({s.PO}) = count(*) OVER (PARTITION BY ticker) THEN " + " + ".join(f"{w!r}::DOUBLE * coalesce(lag(close, {k}) OVER ({s.PO}), 0)" for k, w in enumerate(WEIGHTS)) + " END"},
    ]),
    "fe01_fe13_enriched": (shape.enriched, [
        *PREPARED,
        {
            "log_high_low_range": f"ln(high / {AL('low')})", "log_vwap_close": f"ln(vwap / {AL('close')})", "overnight_return": f"ln(open / {AL('_prev')})", "intraday_return": f"ln(close / {AL('open')})",
            "upper_shadow_pct": s.clip("(high - greatest(open, close)) / _range", 0, 1), "lower_shadow_pct": s.clip("(least(open, close) - low) / _range", 0, 1), "body_pct": s.clip("abs(close - open) / _range", 0, 1), "high_close_pct": s.clip("(high - close) / _range", 0, 1),
            "_vcr": f"close / {AL('vwap')}", "log_dollar_volume": f"ln({s.clip('_dollars', 1)})", "_tpd": f"transactions / {AL('_dollars')} * 1e6", "_gain": "coalesce(greatest(close - _prev, 0), 0)", "_loss": "coalesce(greatest(_prev - close, 0), 0)", "_tr": TRUE_RANGE,
            "_sma20": s.mean("close", 20, 15), "_sma50": s.mean("close", 50, 35), "_bb": s.std("close", 20, 15), "_ema10": s.ewm("close", 2 / 11, 7),
        },
        {f"_{x}{n}": s.ewm(f"_{x}", 1 / n, n) for n in (14, 5) for x in ("gain", "loss")},
        {
            "close_to_vwap_z20": s.z("_vcr", 20, 10, E9), "dollar_volume_z20": s.z("_dollars", 20, 10, E9), "relative_volume_20d": f"volume / {AL(s.mean('volume', 20, 10))}", "volume_return_corr_20d": s.corr("volume", "_abs", 20, 15), "txn_per_dollar_z20": s.z("_tpd", 20, 10, E9),
            **{f"ret_{n}d": s.total("_ret", n, m) for n, m in ((5, 3), (10, 7), (20, 15), (60, 40))}, **{f"rsi_{n}": f"100 - 100 / (1 + _gain{n} / {AL(f'_loss{n}')})" for n in (14, 5)},
            "price_vs_sma20": f"close / {AL('_sma20')} - 1", "price_vs_sma50": f"close / {AL('_sma50')} - 1", "price_vs_ema10": f"close / {AL('_ema10')} - 1", "sma20_slope_5": f"(_sma20 - {s.lag('_sma20', 5)}) / {AL(s.lag('_sma20', 5))}",
            "bollinger_pct": s.clip(f"(close - (_sma20 - 2 * _bb)) / {AL('4 * _bb')}", -0.5, 1.5), "atr_14_pct": f"{s.mean('_tr', 14)} / {AL('close')}",
        },
    ]),
    "fv01_fv10_w22_pressure_velocity": (shape.pressure_velocity, [
        *PREPARED,
        {
            "_i": f"row_number() OVER ({s.PO})", "clv": "_clv", "buying_pressure": "volume * _clv", "selling_pressure": "volume * (1 - _clv)", "volume_force": "_ret * volume", "price_efficiency": s.clip("abs(close - open) / _range", 0, 1), "gap_pct": f"(open - _prev) / {AL('_prev')}",
            "volume_accel": f"volume / {AL(s.mean('volume', 20, 10))}", "dollar_volume_accel": f"_dollars / {AL(s.mean('_dollars', 20, 10))}", "ad_line": f"sum(_clv * volume) OVER {s.ALL}",
        },
        *RUN("_ret > 0", "consec_up_days"), *RUN("_ret < 0", "consec_down_days"),
        {
            "pressure_ratio": f"buying_pressure / {AL('buying_pressure + selling_pressure')}", "gap_direction": "sign(gap_pct)", "run_length": "(consec_up_days - consec_down_days)::DOUBLE", "velocity_5d": EPS_SLOPE("close", 5), "velocity_20d": EPS_SLOPE("close", 20),
            "volume_force_5d": s.total("volume_force", 5, 3), "volume_force_20d": s.total("volume_force", 20, 10), "volume_accel_5d_avg": s.mean("volume_accel", 5, 3), "ad_line_slope_5d": EPS_SLOPE("ad_line", 5), "ad_line_slope_20d": EPS_SLOPE("ad_line", 20),
        },
        {"pressure_ratio_5d": s.mean("pressure_ratio", 5, 3), "pressure_ratio_20d": s.mean("pressure_ratio", 20, 10)},
        {"pressure_velocity_composite": BLEND((0.30, "((pressure_ratio_20d - 0.5) * 2)"), (0.25, DEV("volume_force_20d")), (0.20, "tanh(run_length / 5)"), (0.10, "tanh((volume_accel - 1) / 2)"), (0.15, DEV("ad_line_slope_20d")))},
    ]),
    "fo01_fo08_w23_order_flow": (shape.order_flow, [
        *PREPARED,
        {"ofi_proxy": "_clv * volume * sign(coalesce(_ret, 0))", "_buy": f"volume * {s.clip('(_clv + 1) / 2', 0, 1)}", "_sell": f"volume * (1 - {s.clip('(_clv + 1) / 2', 0, 1)})", "price_impact_per_volume": f"_abs / {AL('volume')} * 1e6", "_row": f"row_number() OVER ({s.PO})"},
        {"_sign": "sign(ofi_proxy)", "ofi_intensity": f"ofi_proxy / {AL(s.mean('volume', 20, 10))}", **{f"{k}_volume_pct": f"_{k} / {AL('_buy + _sell')}" for k in ("buy", "sell")}, "net_flow_ratio": f"(_buy - _sell) / {AL('_buy + _sell')}", "ofi_proxy_5d": s.total("ofi_proxy", 5, 3), "ofi_proxy_20d": s.total("ofi_proxy", 20, 10), "price_impact_z20": s.z("price_impact_per_volume", 20, 10, E9)},
        {**{f"ofi_persistence_{n}d": f"CASE WHEN _row >= {n} THEN len(list_filter(list(_sign) OVER {s.frame(n)}, lambda v: v = _sign)) / len(list(_sign) OVER {s.frame(n)})::DOUBLE END" for n in (5, 20)}, "net_flow_ratio_5d": s.mean("net_flow_ratio", 5, 3), "net_flow_ratio_20d": s.mean("net_flow_ratio", 20, 10), "_ret5": s.total("_ret", 5, 3)},
        {"flow_momentum": f"net_flow_ratio_5d - {s.lag('net_flow_ratio_5d', 5)}", "flow_volume_divergence": s.clip("tanh((net_flow_ratio_5d - net_flow_ratio_20d) * 5) - tanh(_ret5 * 10)", -2, 2)},
        {"flow_acceleration": f"flow_momentum - {s.lag('flow_momentum', 5)}", "ofi_composite": BLEND((0.25, "tanh(ofi_intensity)"), (0.25, s.clip("net_flow_ratio_20d", -1, 1)), (0.20, "((coalesce(ofi_persistence_20d, 0.5) - 0.5) * 2)"), (0.15, "tanh(flow_momentum * 5)"), (0.15, "tanh(flow_volume_divergence)"))},
    ]),
    "fl01_fl08_w10_session_liquidity": (shape.session_liquidity, [
        *PREPARED,
        {"spread_proxy": f"_range / {AL('vwap')}", "_v20": AL(s.mean("volume", 20, 10)), "_vs": s.std("volume", 20, 10), "txn_density": "transactions / _range", "illiquidity_amihud": f"_abs / {AL('_dollars')} * 1e8"},
        {
            "dollar_depth": f"_dollars / {AL('spread_proxy')}", "spread_proxy_5d": s.mean("spread_proxy", 5, 3), "spread_proxy_20d": s.mean("spread_proxy", 20, 10), "volume_stability": "_vs / _v20", "txn_density_z20": s.z("txn_density", 20, 10, E9),
            "illiquidity_amihud_5d": s.mean("illiquidity_amihud", 5, 3), "illiquidity_amihud_20d": s.mean("illiquidity_amihud", 20, 10), "liquidity_shock": f"CASE WHEN {s.z('illiquidity_amihud', 20, 10, E9)} > 2 THEN 1 ELSE 0 END", "dryup_score": f"1 - {s.clip('volume / _v20', 0, 3)}",
            "liquidity_score": s.clip(f"0.40 * ({s.rank('volume', 'ticker')} * 2 - 1) + 0.35 * ((1 - {s.rank('spread_proxy', 'ticker')}) * 2 - 1) + 0.25 * ({s.rank('transactions', 'ticker')} * 2 - 1)", -1, 1),
        },
        *RUN("volume < _v20", "dryup_streak"),
        {"dollar_depth_z20": s.z("dollar_depth", 20, 10, E9), "spread_narrowing": f"(spread_proxy_20d - spread_proxy) / {AL('spread_proxy_20d')}", "liquidity_score_5d": s.mean("liquidity_score", 5, 3), "liquidity_score_20d": s.mean("liquidity_score", 20, 10)},
        {"liquidity_trend": "liquidity_score_5d - liquidity_score_20d"},
        {"session_liquidity_composite": BLEND((0.30, "liquidity_score_20d"), (0.25, "tanh(liquidity_trend * 5)"), (0.20, "(-tanh(illiquidity_amihud_20d * 100))"), (0.15, "tanh(dollar_depth_z20 / 2)"), (0.10, "(-tanh(dryup_score))"))},
    ]),
    "fm01_fm09_volume_microstructure": (shape.volume_structure, [
        *PREPARED,
        {
            "vwap_deviation": f"(close - vwap) / {AL('vwap')}", "volume_vs_range": "volume / _range", "txn_avg_size": "volume / greatest(transactions, 1)", "stealth_accumulation": s.clip(f"{s.z('volume', 20, 10, E9)} - {s.z('_abs', 20, 10, E9)}", -5, 5), "volume_concentration": f"volume / {AL(s.total('volume', 20, 10))}",
            "smart_money_flow": "_clv * volume * sign(coalesce(_ret, 0))", "absorption_ratio": f"_dollars / ({AL('_abs')} * close * 1e6)", "volume_divergence": s.clip(f"{s.mean('volume', 10, 5)} / {AL(s.mean('volume', 20, 10))} - {s.mean('_abs', 10, 5)} / {AL(s.mean('_abs', 20, 10))}", -3, 3),
        },
        {
            "vwap_deviation_5d": s.mean("vwap_deviation", 5, 3), "vwap_deviation_20d": s.mean("vwap_deviation", 20, 10), "volume_vs_range_z20": s.z("volume_vs_range", 20, 10, E9), "stealth_score_5d": s.mean("stealth_accumulation", 5, 3), "stealth_score_20d": s.mean("stealth_accumulation", 20, 10), "txn_size_z20": s.z("txn_avg_size", 20, 10, E9),
            "smart_money_flow_5d": s.total("smart_money_flow", 5, 3), "smart_money_flow_20d": s.total("smart_money_flow", 20, 10), "absorption_ratio_z20": s.z("absorption_ratio", 20, 10, E9),
        },
        {"block_trade_proxy": "CASE WHEN txn_size_z20 > 2 THEN 1 ELSE 0 END", "_smart": f"tanh(coalesce(smart_money_flow_20d, 0) / {AL(s.std('smart_money_flow_20d', 60, 20))})"},
        {"microstructure_composite": f"CASE WHEN _smart IS NOT NULL THEN {BLEND((0.25, 'tanh(stealth_score_20d / 2)'), (0.25, '_smart'), (0.20, 'tanh(volume_divergence)'), (0.15, 'tanh(vwap_deviation_20d * 20)'), (0.15, 'tanh(absorption_ratio_z20 / 2)'))} END"},
    ]),
}
LEAST = {"fe01_fe13_enriched": 20, "fv01_fv10_w22_pressure_velocity": 5}
#: Places for columns whose ratios to tiny ranges reach 1e13; others are compared to six.
PLACES = {"dollar_depth": -3, "volume_vs_range": 2, "txn_density": 2}


def query(name: str):
    operator, levels = LEVELS[name]
    return lambda spark, sf_dir: rounded(operator(bars(spark, sf_dir)), outputs(levels), places=PLACES)


def ranked(spark, sf_dir):
    features = ("log_return_1d", "garman_klass_var_1d", "volume_robust_z", "trade_size_robust_z", "clv")
    return rounded(shape.sector_ranks(shape.transformed(bars(spark, sf_dir, True)), features), [f"{x}_sector_rank" for x in features])


def oracle(name: str) -> str:
    least = LEAST.get(name, 1 if name.startswith("fp") else 10)
    full = "full_ AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS _n FROM bars) WHERE _n >= %d)" % least
    return s.chain(f"{s.BARS}, {full}", *LEVELS[name][1], start="full_", places=PLACES)


RANK_LEVEL = {f"{x}_sector_rank": s.rank(x, "date", "sector") for x in ("log_return_1d", "garman_klass_var_1d", "volume_robust_z", "trade_size_robust_z", "clv")}
QUERIES = {name: query(name) for name in LEVELS} | {"fp07_w09_sector_ranks": ranked}
ORACLES = {name: oracle(name) for name in LEVELS} | {"fp07_w09_sector_ranks": s.chain(s.BARS, *LEVELS["fp01_fp06_w08_w25_transformed"][1], RANK_LEVEL, start="sbars", out=list(RANK_LEVEL))}
