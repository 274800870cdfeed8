"""Queries FS, FN, W11-W14, W27: sector overlays and normalisation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillon.operators import cross, series, shape
from quillon.plans import sql as s
from quillon.plans.series import LABELS, ou_levels
from quillon.plans.shape import LEVELS as SHAPE
from quillon.plans.technicals import CHG, rounded
from quillon.sources.panels import bars

TRANSFORMED = SHAPE["fp01_fp06_w08_w25_transformed"][1]
DAILY_OUT = ["sector_return_1d", "sector_volatility_1d", "sector_volume_shock_1d", "sector_trade_size_shock_1d", "market_return_1d", "market_return_20d_mean", "sector_return_20d_mean", "sector_realized_vol_20d", "sector_relative_strength_20d"]
SW, DW = "(PARTITION BY sector ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "(ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
FULL = lambda f, x, w, n=20: f"(CASE WHEN count({x}) OVER {w} >= {n} THEN {f}({x}) OVER {w} END)"


def levels_sql(levels, start="sbars", tag="t"):
    out, last = [], start
    for k, level in enumerate(levels):
        out.append(f"{tag}{k} AS (SELECT *, {', '.join(f'{x} AS {y}' for y, x in level.items())} FROM {last})")
        last = f"{tag}{k}"
    return ", ".join(out), last


CHAIN, LAST = levels_sql(TRANSFORMED)
DAILY_SQL = f"""{s.BARS}, {CHAIN}, per AS (
  SELECT date, sector, count(DISTINCT ticker) AS sector_member_count, avg(log_return_1d) AS sector_return_1d, avg(garman_klass_var_1d) AS sector_volatility_1d, avg(volume_robust_z) AS sector_volume_shock_1d, avg(trade_size_robust_z) AS sector_trade_size_shock_1d
  FROM {LAST} WHERE sector IS NOT NULL GROUP BY date, sector
), market AS (SELECT *, {FULL("avg", "market_return_1d", DW)} AS market_return_20d_mean FROM (SELECT date, avg(log_return_1d) AS market_return_1d FROM {LAST} WHERE sector IS NOT NULL GROUP BY date)),
daily AS (SELECT per.*, market_return_1d, market_return_20d_mean, {FULL("avg", "sector_return_1d", SW)} AS sector_return_20d_mean, {FULL("stddev_samp", "sector_return_1d", SW)} AS sector_realized_vol_20d,
  CASE WHEN sector_return_1d < -0.02 THEN 1 ELSE 0 END AS sector_high_risk_flag FROM per LEFT JOIN market USING (date)),
full_ AS (SELECT *, sector_return_20d_mean - market_return_20d_mean AS sector_relative_strength_20d FROM daily)"""
PW = "(PARTITION BY a.sector, b.sector ORDER BY a.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
CONTAGION_SQL = f"""WITH {DAILY_SQL}, grid AS (SELECT d.date, c.sector, p.sector_return_1d AS x FROM (SELECT DISTINCT date FROM per) d CROSS JOIN (SELECT DISTINCT sector FROM per) c LEFT JOIN per p ON p.date = d.date AND p.sector = c.sector),
st AS (SELECT *, count(x) OVER {SW} AS k, avg(x) OVER {SW} AS m, stddev_pop(x) OVER {SW} AS sd, row_number() OVER (PARTITION BY sector ORDER BY date) AS i FROM grid),
pr AS (SELECT a.date, a.sector, a.i, a.k AS ka, b.k AS kb, a.sd AS sa, b.sd AS sb, a.m AS ma, b.m AS mb, count(a.x + b.x) OVER {PW} AS n, sum(a.x * b.x) OVER {PW} AS xy, sum(CASE WHEN b.x IS NOT NULL THEN a.x END) OVER {PW} AS xa, sum(CASE WHEN a.x IS NOT NULL THEN b.x END) OVER {PW} AS xb
  FROM st a JOIN st b ON a.date = b.date AND a.sector <> b.sector)
SELECT date, sector, {s.rounded("avg(CASE WHEN n >= 3 AND ka >= 3 AND kb >= 3 AND sa >= 1e-12 AND sb >= 1e-12 THEN abs(least(greatest((xy - ma * xb - mb * xa + n * ma * mb) / n / (sa * sb), -1), 1)) END)")} AS sector_contagion_score_20d
FROM pr WHERE i >= 20 GROUP BY date, sector"""
STRETCHES = [f"ou_{label}_stretch_{n}" for label, _ in LABELS.values() for n in series.OU_WINDOWS]
OUC, OUL = levels_sql(ou_levels(series.OU_FEATURES), tag="u")


def daily(spark, sf_dir):
    return cross.sector_daily(shape.transformed(bars(spark, sf_dir, True)))


def fs_daily(spark, sf_dir):
    return rounded(daily(spark, sf_dir), DAILY_OUT, ("date", "sector", "sector_member_count", "sector_high_risk_flag"))


def fs_contagion(spark, sf_dir):
    return rounded(cross.contagion(daily(spark, sf_dir)), ["sector_contagion_score_20d"], ("date", "sector"))


def fs_means(spark, sf_dir):
    panel = series.mean_reversion(shape.transformed(bars(spark, sf_dir, True)).select("ticker", "date", "sector", *series.OU_FEATURES))
    columns = [x for x in panel.columns if re.fullmatch(r"ou_.+_stretch_\d+", x)]
    return rounded(cross.sector_means(panel, columns), [f"sector_{x}" for x in columns], ("date", "sector"), digits=4)


def fs_latest(spark, sf_dir):
    out = daily(spark, sf_dir)
    last = out.agg(F.max("date").alias("date"))
    out = out.join(F.broadcast(last), "date", "left_semi").orderBy(F.col("sector_relative_strength_20d").desc_nulls_last(), "sector").limit(50)
    return rounded(out, ["sector_return_1d", "sector_relative_strength_20d"], ("date", "sector"))


def fn_universe(spark, sf_dir):
    return rounded(cross.with_members(bars(spark, sf_dir, True), least_volume=20.0), ["price_filter_lagged", "adv_22d_lagged", "vol_22d_lagged"], ("ticker", "date", "in_universe"))


UNIVERSE = [
    {"_fail": "close IS NULL OR close <= 0 OR volume IS NULL OR volume <= 0", "_log": s.log("close")},
    {"_fl": f"coalesce({s.lag('_fail', 2)}, true)", "price_filter_lagged": s.lag("close", 2), "_lv": s.lag("volume", 2), "_r": f"_log - {s.lag('_log')}"},
    {"adv_22d_lagged": s.mean("_lv", 22, 11), "_lr": s.lag("_r", 2), "_clean": f"sum((NOT _fl)::INT) OVER {s.ALL}"},
    {"vol_22d_lagged": s.clip(s.std("_lr", 22, 22), 1e-6), "in_universe": "coalesce(price_filter_lagged >= 10 AND adv_22d_lagged >= 20 AND _clean >= 60 AND NOT _fl, false)"},
]


def fn_lagged(spark, sf_dir):
    df = cross.with_members(bars(spark, sf_dir, True), least_volume=20.0).withColumn("ret_5d", F.col("_log") - F.lag("_log", 5).over(series.c.series()))
    return rounded(cross.lagged_normalised(df, "ret_5d"), ["ret_5d", "ret_5d_pctrank", "ret_5d_zscore"])


UC, UL = levels_sql([*UNIVERSE, {"ret_5d": f"_log - {s.lag('_log', 5)}"}], tag="u")
GS = "(PARTITION BY date, sector)"
LW = "(PARTITION BY sector ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)"
LAGGED_SQL = f"""WITH {s.BARS}, {UC}, v AS (SELECT * FROM {UL} WHERE in_universe AND ret_5d IS NOT NULL AND sector IS NOT NULL),
m AS (SELECT *, median(ret_5d) OVER {GS} AS med FROM v), d AS (SELECT *, median(abs(ret_5d - med)) OVER {GS} AS mad FROM m),
c AS (SELECT *, CASE WHEN mad > 0 THEN least(greatest(ret_5d, med - 5 * mad), med + 5 * mad) ELSE ret_5d END AS clip FROM d),
k AS (SELECT *, CASE WHEN count(*) OVER {GS} >= 10 THEN {s.rank("clip", "date", "sector")} END AS pr FROM c),
g AS (SELECT date, sector, CASE WHEN count(*) >= 10 THEN avg(clip) END AS m, CASE WHEN count(*) >= 10 THEN stddev_samp(clip) END AS sd FROM c GROUP BY date, sector),
p AS (SELECT date, sector, {FULL("avg", "m", LW)} AS lm, {FULL("avg", "sd", LW)} AS ls FROM g)
SELECT u.ticker, u.date, {s.rounded("u.ret_5d")} AS ret_5d, {s.rounded("k.pr")} AS ret_5d_pctrank, {s.rounded("CASE WHEN p.ls > 0 THEN (k.clip - p.lm) / p.ls END")} AS ret_5d_zscore
FROM {UL} u LEFT JOIN k ON k.ticker = u.ticker AND k.date = u.date LEFT JOIN p ON p.date = k.date AND p.sector = k.sector"""
INST = [
    {"_log": s.log("close"), "_ok": "close IS NOT NULL"}, {"_r": f"_log - {s.lag('_log')}", "history_days": f"sum(_ok::INT) OVER {s.ALL}"},
    {"_lr": s.lag("_r", 2), **{f"ret_{h}d": f"_log - {s.lag('_log', h)}" for h in (5, 21, 63)}, **{f"fwd_ret_{h}d": f"{s.lag('_log', -h)} - _log" for h in (20, 60, 90)}, "in_universe": "history_days >= 60 AND _ok"},
    {"vol_22d": s.clip(s.std("_lr", 22, 10), 0.005)}, {f"ret_{h}d_voladj": s.div(f"ret_{h}d", f"(vol_22d * sqrt({h}))") for h in (5, 21, 63)},
]
NORM = [
    {"_v": "CASE WHEN in_universe AND sector IS NOT NULL THEN ret_21d_voladj END"}, {"_med": f"median(_v) OVER {GS}"}, {"_mad": f"median(abs(_v - _med)) OVER {GS}"}, {"_clip": "CASE WHEN _v IS NOT NULL THEN least(greatest(_v, _med - 5 * _mad), _med + 5 * _mad) END"},
    {"ret_21d_voladj_zscore": f"CASE WHEN count(_v) OVER {GS} >= 10 THEN {s.group_z('_clip', 'date', 'sector', least=10)} END", "ret_21d_voladj_pctrank": f"CASE WHEN count(_v) OVER {GS} >= 10 THEN {s.rank('_v', 'date', 'sector')} END"},
]
INST_OUT = ["history_days", "vol_22d", *[f"ret_{h}d" for h in (5, 21, 63)], *[f"fwd_ret_{h}d" for h in (20, 60, 90)], *[f"ret_{h}d_voladj" for h in (5, 21, 63)]]
NORM_OUT = ["ret_21d_voladj_zscore", "ret_21d_voladj_pctrank"]


def fn_institutional(spark, sf_dir):
    return rounded(cross.institutional(bars(spark, sf_dir, True)), INST_OUT, ("ticker", "date", "in_universe"))


def fn_normalised(spark, sf_dir):
    return rounded(cross.sector_normalised(cross.institutional(bars(spark, sf_dir, True)), "ret_21d_voladj"), NORM_OUT)


QUERIES = {"fs01_fs04_a01_a02_j4_sector_daily": fs_daily, "fs06_w27_u06_contagion": fs_contagion, "fs05_a03_j5_sector_means": fs_means, "t04_sector_latest": fs_latest, "f13_f14_universe_membership": fn_universe, "fn_w12_w13_j16_lagged_normalised": fn_lagged, "fn_f15_w02_institutional_returns": fn_institutional, "fn_w11_w12_sector_normalised": fn_normalised}
ORACLES = {
    "fs01_fs04_a01_a02_j4_sector_daily": f"WITH {DAILY_SQL} SELECT date, sector, sector_member_count, sector_high_risk_flag, {', '.join(f'{s.rounded(x)} AS {x}' for x in DAILY_OUT)} FROM full_",
    "fs06_w27_u06_contagion": CONTAGION_SQL,
    "fs05_a03_j5_sector_means": f"WITH {s.BARS}, {OUC} SELECT date, sector, {", ".join(f"{s.rounded(f'avg({x})', 4)} AS sector_{x}" for x in STRETCHES)} FROM {OUL} WHERE sector IS NOT NULL GROUP BY date, sector",
    "t04_sector_latest": f"WITH {DAILY_SQL} SELECT date, sector, {s.rounded('sector_return_1d')} AS sector_return_1d, {s.rounded('sector_relative_strength_20d')} AS sector_relative_strength_20d FROM full_ WHERE date = (SELECT max(date) FROM full_) ORDER BY sector_relative_strength_20d DESC NULLS LAST, sector LIMIT 50",
    "f13_f14_universe_membership": s.chain(s.BARS, *UNIVERSE, start="sbars", keys="ticker, date, in_universe", out=["price_filter_lagged", "adv_22d_lagged", "vol_22d_lagged"]),
    "fn_w12_w13_j16_lagged_normalised": LAGGED_SQL,
    "fn_f15_w02_institutional_returns": s.chain(s.BARS, *INST, start="sbars", keys="ticker, date, in_universe", out=INST_OUT),
    "fn_w11_w12_sector_normalised": s.chain(s.BARS, *INST, *NORM, start="sbars", out=NORM_OUT),
}
