"""Queries FU, FD, FQ, FX: mean reversion, stress, residual and macro series."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import series, shape
from quillon.plans import sql as s
from quillon.plans.shape import LEVELS as SHAPE
from quillon.plans.technicals import CHG, rounded
from quillon.sources import sinks
from quillon.sources.panels import bars, index_bars, sector_closes

PROXIES = ("africa", "asia", "europe")
OTHERS = {"tlt": "2", "hyg": "3", "lqd": "4", "vixy": "5"}
LABELS = {x: (f"{x}_log1p", f"ln(1 + greatest({x}, 0))") if x == "garman_klass_var_1d" else (x, x) for x in series.OU_FEATURES}


def ou(names: tuple[str, ...], stats: tuple[str, ...]):
    out = [f"ou_{LABELS[x][0]}_{st}_{n}" for x in names for n in series.OU_WINDOWS for st in stats]
    return lambda spark, sf_dir: rounded(series.mean_reversion(shape.transformed(bars(spark, sf_dir)).select("ticker", "date", *names), names), out, digits=4)  # what a grouped map gets isn't pruned


def ou_levels(names: tuple[str, ...]) -> list[dict[str, str]]:
    levels = [dict(level) for level in SHAPE["fp01_fp06_w08_w25_transformed"][1]]
    levels.append({f"_s{k}": LABELS[x][1] for k, x in enumerate(names)} | {"_row": f"row_number() OVER ({s.PO})"})
    levels.append({f"_x{k}": f"CASE WHEN _s{k} IS NOT NULL THEN {s.lag(f'_s{k}')} END" for k in range(len(names))})
    levels.append({f"_y{k}": f"CASE WHEN _x{k} IS NOT NULL THEN _s{k} END" for k in range(len(names))})
    sums, slopes, rest, last, vel = {}, {}, {}, {}, {}
    for k, x in enumerate(names):
        for n in series.OU_WINDOWS:
            w, p, name = s.frame(n - 1, 1), f"_{k}_{n}_", f"ou_{LABELS[x][0]}_{{}}_{n}"
            sums |= {p + "n": f"count(_y{k}) OVER {w}", p + "h": f"count(_s{k}) OVER {s.frame(n, 1)}", p + "mx": f"avg(_x{k}) OVER {w}", p + "my": f"avg(_y{k}) OVER {w}", p + "xx": f"regr_sxx(_y{k}, _x{k}) OVER {w}", p + "yy": f"regr_syy(_y{k}, _x{k}) OVER {w}", p + "xy": f"regr_sxy(_y{k}, _x{k}) OVER {w}"}
            b = s.div(p + "xy", p + "xx", 1e-12)
            slopes[p + "b"] = f"CASE WHEN _row > {n} AND {p}h >= 15 AND {p}n >= 2 AND _s{k} IS NOT NULL AND {b} > 0 AND {b} < 1 THEN {b} END"
            rest |= {p + "r": f"greatest({p}yy - {p}b * {p}xy, 0)", name.format("b"): p + "b", name.format("mu"): f"({p}my - {p}b * {p}mx) / (1 - {p}b)", name.format("half_life"): f"ln(2) / -ln({p}b)"}
            last |= {name.format("sigma_eq"): f"CASE WHEN 1 - {p}b * {p}b > 1e-12 THEN sqrt({p}r / ({p}n - 1)) / sqrt(1 - {p}b * {p}b) END", name.format("r_squared"): f"CASE WHEN {p}b IS NOT NULL THEN coalesce(least(greatest(1 - {s.div(p + 'r', p + 'yy', 1e-12)}, 0), 1), 0) END"}
            vel[name.format("stretch")] = s.div(f"_s{k} - {name.format('mu')}", name.format("sigma_eq"), 1e-12)
    tail = [{name.replace("_stretch_", "_valid_"): f"({name} IS NOT NULL)::INT" for name in vel} | {name.replace("_stretch_", f"_stretch_vel_{v}d_"): f"{name} - {s.lag(name, v)}" for name in vel for v in (5, 10)}]
    return [*levels, sums, slopes, rest, last, vel, *tail]


def ou_sql(names: tuple[str, ...], stats: tuple[str, ...]) -> str:
    out = [f"ou_{LABELS[x][0]}_{st}_{n}" for x in names for n in series.OU_WINDOWS for st in stats]
    return s.chain(s.BARS, *ou_levels(names), out=out, digits=4)


FULL = ("b", "half_life", "r_squared", "valid", "mu", "sigma_eq", "stretch", "stretch_vel_5d", "stretch_vel_10d")
Z = lambda x, n=20: s.div(f"{x} - {s.mean(x, n)}", s.std(x, n), 1e-12)
STRESS = [
    {"_ret": CHG("close"), "_range": s.div("high - low", "close", 1e-12), "vdce_dd_60": f"{s.div('close', s.high('close', 60), 1e-12)} - 1", "_rv": s.div("volume", s.mean("volume", 20), 1e-12), "_vd": s.div("close - vwap", "close", 1e-12)},
    {"_rv5": s.std("_ret", 5), "_rv20": s.std("_ret", 20), "vdce_dd_velocity": f"vdce_dd_60 - {s.lag('vdce_dd_60')}", "vdce_range_z": Z("_range"), "_vz": Z("_rv"), "_vwz": Z("_vd")},
    {"vdce_vol_ratio": s.div("_rv5", "_rv20", 1e-12), "vdce_vol_of_vol": s.std("_rv5", 20), "_vv": f"_vz - {s.lag('_vz')}"},
    {"vdce_vol_acceleration": f"_vv - {s.lag('_vv')}"},
    {"vdce_stress_raw": f"1.2 * {Z('vdce_vol_ratio')} + {Z('vdce_vol_of_vol')} + {Z('vdce_dd_velocity')} + {Z('vdce_dd_60', 60)} + 0.8 * vdce_range_z + 0.8 * {Z('vdce_vol_acceleration')} + 0.4 * _vwz"},
    {"vdce_stress": f"CASE WHEN count(vdce_stress_raw) OVER {s.ALL} > 0 THEN {s.ewm('vdce_stress_raw', 1 / 3, 1)} END"},
    {"vdce_state_numeric": "CASE WHEN vdce_stress <= 1 THEN 0 WHEN vdce_stress <= 2 THEN 1 WHEN vdce_stress <= 3 THEN 2 ELSE 3 END", "vdce_stress_vel_5d": f"vdce_stress - {s.lag('vdce_stress', 5)}"},
    {"vdce_event_up": f"CASE WHEN vdce_state_numeric > {s.lag('vdce_state_numeric')} THEN 1 ELSE 0 END", "vdce_stress_accel": f"vdce_stress_vel_5d - {s.lag('vdce_stress_vel_5d', 5)}"},
]
STRESS_OUT = [x for level in STRESS for x in level if not x.startswith("_")]
STATE_SQL = s.chain(s.BARS, *STRESS, out=STRESS_OUT, keys="ticker, date, ['GREEN', 'YELLOW', 'ORANGE', 'RED'][vdce_state_numeric + 1] AS vdce_state")
INDEX = "full_ AS (SELECT ticker, date, open, high, low, close, volume, vwap FROM bars UNION ALL SELECT 'IDX', date, avg(open), max(high), min(low), avg(close), sum(volume), avg(vwap) FROM bars GROUP BY date)"
LEADER_SQL = f"""WITH v AS ({s.chain(f"{s.BARS}, {INDEX}", *STRESS, out=["vdce_stress_raw"], start="full_", keys="ticker, date, vdce_stress, vdce_event_up::DOUBLE AS e")}),
own AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS d FROM v WHERE ticker <> 'IDX'),
j AS (SELECT own.ticker, own.date, own.vdce_stress AS x, i.e, count(*) OVER (PARTITION BY own.ticker) AS n FROM own JOIN v i ON i.ticker = 'IDX' AND i.date = own.date WHERE d >= 200 AND own.vdce_stress IS NOT NULL),
l AS (SELECT ticker, k, e, lag(x, k::INT) OVER (PARTITION BY ticker, k ORDER BY date) AS x FROM (SELECT j.*, unnest(range(5, 11)) AS k FROM j) WHERE n >= 180),
c AS (SELECT ticker, k, CASE WHEN stddev_pop(x) >= 1e-12 AND stddev_pop(e) >= 1e-12 THEN covar_pop(x, e) / (stddev_pop(x) * stddev_pop(e)) END AS r FROM l WHERE x IS NOT NULL GROUP BY ticker, k HAVING count(*) >= 80)
SELECT t.ticker, {s.rounded("avg(r)")} AS vdce_leader_score FROM (SELECT DISTINCT ticker FROM j WHERE n >= 180) t LEFT JOIN c USING (ticker) GROUP BY t.ticker"""

BY = "PARTITION BY {} ORDER BY date"
F20 = "({} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def ZP(x: str, by: str) -> str:
    w = F20.format(BY.format(by))
    return f"(CASE WHEN count({x}) OVER {w} >= 20 THEN {s.div(f'{x} - avg({x}) OVER {w}', f'stddev_pop({x}) OVER {w}')} END)"


def CORR(y: str) -> str:
    w = s.frame(60)
    return f"(CASE WHEN count(ret_1 + {y}) OVER {w} >= 60 THEN {s.div(f'covar_pop(ret_1, {y}) OVER {w}', f'(stddev_pop(ret_1) OVER {w} * stddev_pop({y}) OVER {w})')} END)"


QMPC_SQL = f"""WITH {s.BARS}, r AS (SELECT ticker, date, {CHG("close")} AS ret_1 FROM bars), z AS (SELECT *, {ZP("ret_1", "ticker")} AS z_ticker FROM r),
m AS (SELECT label, date, close / lag(close) OVER ({BY.format("label")}) - 1 AS r FROM (SELECT lower(sector) AS label, date, avg(close) AS close FROM sbars GROUP BY ALL)), mz AS (SELECT *, {ZP("r", "label")} AS z FROM m),
j AS (SELECT z.*, {", ".join(f"{k}.r AS {k}_r, {k}.z AS {k}_z" for k in PROXIES)} FROM z {" ".join(f"LEFT JOIN mz {k} ON {k}.label = '{k}' AND {k}.date = z.date" for k in PROXIES)}),
b AS (SELECT *, {", ".join(f"{CORR(f'{k}_r')} AS beta_{k}" for k in PROXIES)} FROM j),
q AS (SELECT *, {" + ".join(f"(z_ticker - beta_{k} * {k}_z)" for k in PROXIES)} AS qmpc FROM b)
SELECT ticker, date, {", ".join(f"{s.rounded(x)} AS {x}" for x in ("qmpc", "z_ticker", *[f"beta_{k}" for k in PROXIES], "ret_1"))}, qmpc > 2 AND coalesce(ret_1 <= 0, false) AS positive_macro_debt FROM q WHERE qmpc IS NOT NULL"""

RANK = lambda x: f"(CASE WHEN count({x}) OVER {s.ALL} >= 60 THEN CASE WHEN {x} IS NULL THEN 0 ELSE len(list_filter(list({x}) OVER {s.ALL}, lambda v: v < {x})) / (row_number() OVER ({s.PO}) - 1)::DOUBLE END END)"
MACRO = [
    {"macro_spy_ret_1d": CHG("close"), "macro_spy_mom_20d": CHG("close", 20), "macro_spy_mom_60d": CHG("close", 60)},
    {"macro_spy_vol_5d": s.std("macro_spy_ret_1d", 5), "macro_spy_vol_20d": s.std("macro_spy_ret_1d", 20), "sector_dispersion_pressure": s.std("macro_spy_ret_1d", 10), "liquidity_impulse_score": "macro_spy_mom_20d", "liquidity_impulse_5d": f"macro_spy_mom_20d - {s.lag('macro_spy_mom_20d', 5)}", "liquidity_impulse_20d": f"macro_spy_mom_60d - {s.lag('macro_spy_mom_60d', 20)}"},
    {"volatility_instability_pressure": s.div("macro_spy_vol_5d", "macro_spy_vol_20d"), "market_liquidity_fragility_index": f"abs(macro_spy_vol_20d - {s.lag('macro_spy_vol_20d')})", "_li": "abs(liquidity_impulse_5d)", "_z60": f"abs({s.z('macro_spy_vol_20d', 60)})", "signal_stability_index": s.mean("macro_spy_vol_20d", 60), "equity_volatility_divergence_score": "macro_spy_vol_5d - macro_spy_vol_20d"},
    {"financial_intermediation_stability_score": f"-{s.mean('volatility_instability_pressure', 10)}", "systemic_instability_risk_score": f"{s.mean('volatility_instability_pressure', 20)} + {s.mean('market_liquidity_fragility_index', 20)}", "liquidity_regime_shift_probability": RANK("_li"), "structural_break_probability": RANK("_z60")},
    {"intermediation_stress_probability": RANK("systemic_instability_risk_score"), "regime_transition_risk": f"abs(structural_break_probability - {s.lag('structural_break_probability')})"},
    {f"macro_{k}_ret_1d": f"(SELECT r FROM rets WHERE rets.ticker = '{t}' AND rets.date = l4.date)" for k, t in OTHERS.items()},
    {"cross_asset_pressure_index": "coalesce(volatility_instability_pressure, 0) - coalesce(macro_hyg_ret_1d, 0) + coalesce(macro_vixy_ret_1d, 0)"},
]
MACRO_OUT = [x for level in MACRO for x in level if not x.startswith("_")]


def stress_query(spark, sf_dir):
    return rounded(series.stress(bars(spark, sf_dir)), STRESS_OUT, ("ticker", "date", "vdce_state"))


def leaders(spark, sf_dir):
    panel = bars(spark, sf_dir)
    both = panel.unionByName(index_bars(panel))
    # Weekly bars leave fewer joint rows than the 200 of a daily panel.
    return rounded(series.leader_scores(series.stress(both), "IDX", joint=180), ["vdce_leader_score"], ("ticker",))


def qmpc(spark, sf_dir):
    # Read for the panel and for the proxies.
    panel = sinks.stored(bars(spark, sf_dir, True).select("ticker", "date", "close", "sector"))
    return rounded(series.residual_pressure(panel, sector_closes(panel), PROXIES), ["qmpc", "z_ticker", *[f"beta_{k}" for k in PROXIES], "ret_1"], ("ticker", "date", "positive_macro_debt"))


def macro(spark, sf_dir):
    return rounded(series.macro_overlay(bars(spark, sf_dir), "1", OTHERS), MACRO_OUT, ("date",))


CLOSE, REST = ("log_close",), series.OU_FEATURES[1:]
QUERIES = {"fu02_w26_mean_reversion_close": ou(CLOSE, FULL), "fu03_mean_reversion_features": ou(REST, FULL), "fd01_fd06_w33_stress": stress_query, "fd07_a25_w32_leader_scores": leaders, "fq01_fq05_w06_w19_residual_pressure": qmpc, "fx01_fx08_w21_macro_overlay": macro}
ORACLES = {
    "fu02_w26_mean_reversion_close": ou_sql(CLOSE, FULL), "fu03_mean_reversion_features": ou_sql(REST, FULL), "fd01_fd06_w33_stress": STATE_SQL, "fd07_a25_w32_leader_scores": LEADER_SQL, "fq01_fq05_w06_w19_residual_pressure": QMPC_SQL,
    "fx01_fx08_w21_macro_overlay": s.chain(f"{s.BARS}, rets AS (SELECT ticker, date, {CHG('close')} AS r FROM bars), spy AS (SELECT ticker, date, close FROM bars WHERE ticker = '1')", *MACRO, start="spy", keys="date", out=MACRO_OUT),
}
