"""Mean reversion, stress, macro-pressure residual, macro overlay and lead-lag scores."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import columns as c
from quillon.operators import rolled
from quillon.operators.ewm import ewm
from quillon.sources import sinks

OU_FEATURES = ("log_close", "volume_robust_z", "trade_size_robust_z", "garman_klass_var_1d")
OU_WINDOWS = (21, 63, 126)
TINY = 1e-12


def ou_source(x: str) -> tuple[str, Column]:
    """Label and series: variances are taken as log1p of their positive part."""
    return (f"{x}_log1p", F.log1p(c.clip(x, 0))) if x == "garman_klass_var_1d" else (x, F.col(x).cast("double"))


def reversion_fits(x: np.ndarray, n: int, least: int, block: int = 10_000) -> tuple[np.ndarray, ...]:
    """Slope, level, equilibrium deviation and R² of each row's fit on the known values among the ``n`` rows before it.

    Values on both sides of a gap are neighbours. NaN where the row has no
    value or fewer than ``n`` rows before it, where fewer than ``least`` of
    these have one, or where the slope isn't in (0, 1).
    """
    known = np.flatnonzero(~np.isnan(x))
    values, rows = x[known], known[known >= n]
    stop, start = np.searchsorted(known, rows), np.searchsorted(known, rows - n)
    enough = stop - start >= max(3, least)
    rows, stop, start = rows[enough], stop[enough], start[enough]
    out = np.full((4, len(x)), np.nan)
    for k in range(0, len(rows), block):
        at = stop[k : k + block, None] + np.arange(-n, 0)
        pair = at[:, :-1] >= start[k : k + block, None]
        v, size = values[np.maximum(at, 0)], pair.sum(1)
        mean_x, mean_y = (np.where(pair, y, 0).sum(1) / size for y in (v[:, :-1], v[:, 1:]))
        dx, dy = (np.where(pair, y - m[:, None], 0) for y, m in ((v[:, :-1], mean_x), (v[:, 1:], mean_y)))
        xx, xy, yy = (np.einsum("ij,ij->i", *both) for both in ((dx, dx), (dx, dy), (dy, dy)))
        with np.errstate(divide="ignore", invalid="ignore"):
            b = np.where(xx > TINY, xy / xx, np.nan)
            b = np.where((b > 0) & (b < 1), b, np.nan)
            rest = np.maximum(yy - b * xy, 0)
            sigma = np.where(1 - b * b > TINY, np.sqrt(rest / (size - 1)) / np.sqrt(1 - b * b), np.nan)
            r2 = np.where(np.isnan(b), np.nan, np.where(yy > TINY, np.clip(1 - rest / yy, 0, 1), 0))
            out[:, rows[k : k + block]] = b, (mean_y - b * mean_x) / (1 - b), sigma, r2
    return tuple(out)


def mean_reversion(df: DataFrame, features: tuple[str, ...] = OU_FEATURES, windows: tuple[int, ...] = OU_WINDOWS, least: int = 15) -> DataFrame:
    """First-order autoregression of each feature on the ``n`` rows before this one, as a mean-reverting process.

    Outputs are NULL unless the coefficient lies in (0, 1). Gaps are closed
    within a window, which no frame expresses: one Arrow pass per instrument
    fits all features and windows. It takes the rows' differences, too, as a
    window after it would sort and ship the many columns that it makes.
    """
    df = df.withColumns({f"ou_source_{label}": x for label, x in map(ou_source, features)})
    labels = [label for label, _ in map(ou_source, features)]
    fits = [(label, n, [f"ou_{label}_{st}_{n}" for st in ("b", "mu", "sigma_eq", "r_squared")]) for label in labels for n in windows]
    moves = {(label, n): [(v, f"ou_{label}_stretch_vel_{v}d_{n}") for v in (5, 10)] for label, n, _ in fits}

    def fold(g: pa.Table) -> pa.Table:
        g = g.sort_by("date")
        late = []
        for label, n, names in fits:
            x = g.column(f"ou_source_{label}").to_numpy()
            found = reversion_fits(x, n, least)
            for name, y in zip(names, found, strict=True):
                g = g.append_column(name, pa.array(y, from_pandas=True))
            stretch = np.full(len(x), np.nan)
            np.divide(x - found[1], found[2], out=stretch, where=np.abs(found[2]) > TINY)
            late.append((f"ou_{label}_stretch_{n}", stretch))
            for v, name in moves[label, n]:
                late.append((name, np.concatenate([np.full(min(v, len(x)), np.nan), stretch[v:] - stretch[:-v]])))
        for name, y in late:
            g = g.append_column(name, pa.array(y, from_pandas=True))
        return g

    made = [name for *_, names in fits for name in names] + [name for label, n, _ in fits for name in (f"ou_{label}_stretch_{n}", *[x for _, x in moves[label, n]])]
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in made]])
    before = df.columns
    df = df.groupBy("ticker").applyInArrow(fold, schema)
    out = [F.col(x) for x in before] + [F.col(name) for *_, names in fits for name in names]
    for label, n, _ in fits:
        name = f"ou_{label}_{{}}_{n}"
        out += [c.div(F.lit(math.log(2)), -F.ln(name.format("b"))).alias(name.format("half_life")), F.col(name.format("stretch")), F.col(name.format("stretch")).isNotNull().alias(name.format("valid"))]
    return df.select(*out, *[name for key in moves for _, name in moves[key]])


STRESS_PARTS = ("vdce_dd_60", "vdce_dd_velocity", "vdce_range_z", "vdce_vol_ratio", "vdce_vol_of_vol", "vdce_vol_acceleration", "vdce_stress_raw")


def stress_parts(close: np.ndarray, high: np.ndarray, low: np.ndarray, volume: np.ndarray, vwap: np.ndarray) -> dict[str, np.ndarray]:
    """The components of the stress score and their weighted sum, for one instrument's rows."""
    z = lambda x, n=20: rolled.z(x, n, TINY)
    ret, dd = rolled.change(close), rolled.ratio(close, rolled.high(close, 60), TINY) - 1
    short, velocity = rolled.std(ret, 5), rolled.diff(dd)
    ratio = rolled.ratio(short, rolled.std(ret, 20), TINY)
    spread = rolled.std(short, 20)
    range_z, vwap_z = z(rolled.ratio(high - low, close, TINY)), z(rolled.ratio(close - vwap, close, TINY))
    acceleration = rolled.diff(rolled.diff(z(rolled.ratio(volume, rolled.mean(volume, 20), TINY))))
    raw = 1.2 * z(ratio) + z(spread) + z(velocity) + z(dd, 60) + 0.8 * range_z + 0.8 * z(acceleration) + 0.4 * vwap_z
    return dict(zip(STRESS_PARTS, (dd, velocity, range_z, ratio, spread, acceleration, raw), strict=True))


def stress(df: DataFrame) -> DataFrame:
    """Stress score of an instrument and its state. A missing score is RED, as no threshold holds for it.

    The components are one Arrow pass by instrument; select the columns that are needed first.
    """
    df = rolled.by_instrument(df, ("close", "high", "low", "volume", "vwap"), stress_parts, STRESS_PARTS)
    df = ewm(df, {"vdce_stress": ("vdce_stress_raw", 1 / 3, 0)})
    s = F.col("vdce_stress")
    df = df.withColumn("vdce_state_numeric", F.when(s <= 1, 0).when(s <= 2, 1).when(s <= 3, 2).otherwise(3))
    df = df.withColumn("vdce_stress_vel_5d", c.diff("vdce_stress", 5))
    return df.withColumns({
        "vdce_state": F.element_at(F.array(*map(F.lit, ("GREEN", "YELLOW", "ORANGE", "RED"))), F.col("vdce_state_numeric") + 1), "vdce_event_up": F.coalesce((c.diff("vdce_state_numeric") > 0).cast("int"), F.lit(0)), "vdce_stress_accel": c.diff("vdce_stress_vel_5d", 5),
    })


def leader_scores(stressed: DataFrame, index: str, lags: tuple[int, int] = (5, 10), least: int = 80, joint: int = 200, days: int = 200, stored: bool = False) -> DataFrame:
    """(``ticker``, ``vdce_leader_score``): mean over lags of the correlation of earlier stress with the index's events.

    The index is one series; its join is by date.
    """
    # Read three times below; storing it, unless it is ``stored``, saves the windows and the scan behind it.
    stressed = stressed.select("ticker", "date", "vdce_stress", "vdce_event_up")
    stressed = stressed if stored else sinks.stored(stressed)
    events = stressed.where(F.col("ticker") == index).select("date", F.col("vdce_event_up").cast("double").alias("_event"))
    own = stressed.where(F.col("ticker") != index).withColumn("_days", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("_days") >= days)
    both = own.where("vdce_stress is not null").join(events, "date").withColumn("_joint", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("_joint") >= joint)
    steps = range(lags[0], lags[1] + 1)
    both = both.withColumns({f"_x{k}": c.lag("vdce_stress", k) for k in steps})
    sums = []
    for k in steps:
        x, e = F.col(f"_x{k}"), F.when(F.col(f"_x{k}").isNotNull(), F.col("_event"))
        sums += [F.count(x).alias(f"n{k}"), F.covar_pop(x, e).alias(f"cov{k}"), F.stddev_pop(x).alias(f"a{k}"), F.stddev_pop(e).alias(f"b{k}")]
    per = both.groupBy("ticker").agg(*sums)
    # From moments, as a constant side has no correlation.
    each = [F.when((F.col(f"n{k}") >= least) & (F.col(f"a{k}") >= TINY) & (F.col(f"b{k}") >= TINY), F.col(f"cov{k}") / (F.col(f"a{k}") * F.col(f"b{k}"))) for k in steps]
    return per.select("ticker", c.mean_of(*each).alias("vdce_leader_score"))


def residual_pressure(equity: DataFrame, proxies: DataFrame, labels: tuple[str, ...], z_window: int = 20, beta_window: int = 60, threshold: float = 2.0) -> DataFrame:
    """Return z-score against those of macro proxies, weighted by the rolling correlation with each.

    ``proxies`` is long: ``label``, ``date``, ``close``. A proxy has a row per
    date, so that it is broadcast; what rolls by instrument is one Arrow pass.
    """
    w = Window.partitionBy("label").orderBy("date")

    def zp(x: str, n: int, w=None) -> Column:
        sd = F.when(F.count(x).over(c.frame(n, w=w)) >= n, F.stddev_pop(x).over(c.frame(n, w=w)))
        return c.div(F.col(x) - c.mean(x, n, w=w), sd)

    df = equity.where("close is not null").select("ticker", "date", "close").withColumn("ret_1", c.change("close"))
    macro = proxies.where(F.col("label").isin(*labels)).withColumn("r", c.change("close", w=w))
    macro = macro.withColumn("z", zp("r", z_window, w)).groupBy("date").pivot("label", list(labels)).agg(F.first("r").alias("ret_1"), F.first("z").alias("z"))
    df = df.join(F.broadcast(macro), "date", "left").drop("close")  # a row per date
    betas = [f"beta_{x}" for x in labels]

    def fits(ret: np.ndarray, *others: np.ndarray) -> dict[str, np.ndarray]:
        return {"z_ticker": rolled.z(ret, z_window, free=0)} | dict(zip(betas, rolled.correlations(ret, list(others), beta_window), strict=True))

    df = rolled.by_instrument(df, ("ret_1", *[f"{x}_ret_1" for x in labels]), fits, ("z_ticker", *betas))
    parts = [F.col("z_ticker") - F.col(f"beta_{x}") * F.col(f"{x}_z") for x in labels]
    df = df.withColumn("qmpc", sum(parts[1:], parts[0])).where("qmpc is not null")
    return df.withColumn("positive_macro_debt", (F.col("qmpc") > threshold) & F.coalesce(F.col("ret_1") <= 0, F.lit(False))).select("date", "ticker", "qmpc", "z_ticker", *[f"beta_{x}" for x in labels], "ret_1", "positive_macro_debt")


def expanding_rank(x: str, least: int = 60) -> Column:
    """Share of the values so far that are below this one; leading gaps count in the length, a missing value ranks 0.

    For a single macro series: the frame is the whole past.
    """
    own = c.series().rowsBetween(*c.ALL)
    seen = F.collect_list(x).over(own)
    share = F.size(F.filter(seen, lambda v: v < F.col(x))) / (F.row_number().over(c.series()) - 1)
    return F.when(F.size(seen) >= least, F.when(F.col(x).isNull(), 0.0).otherwise(share))


def macro_overlay(bars: DataFrame, spy: str, others: dict[str, str]) -> DataFrame:
    """Market-wide series on the calendar of one instrument: volatility, liquidity impulse, breaks, cross-asset pressure."""
    df = bars.where(F.col("ticker") == spy).select("ticker", "date", "close")
    df = df.withColumns({"macro_spy_ret_1d": c.change("close"), "macro_spy_mom_20d": c.change("close", 20), "macro_spy_mom_60d": c.change("close", 60)})
    df = df.withColumns({"macro_spy_vol_5d": c.std("macro_spy_ret_1d", 5), "macro_spy_vol_20d": c.std("macro_spy_ret_1d", 20), "sector_dispersion_pressure": c.std("macro_spy_ret_1d", 10), "liquidity_impulse_score": F.col("macro_spy_mom_20d"), "liquidity_impulse_5d": c.diff("macro_spy_mom_20d", 5), "liquidity_impulse_20d": c.diff("macro_spy_mom_60d", 20)})
    df = df.withColumns({"volatility_instability_pressure": c.div("macro_spy_vol_5d", "macro_spy_vol_20d"), "market_liquidity_fragility_index": F.abs(c.diff("macro_spy_vol_20d")), "_li": F.abs("liquidity_impulse_5d"), "_z60": F.abs(c.z("macro_spy_vol_20d", 60)), "signal_stability_index": c.mean("macro_spy_vol_20d", 60), "equity_volatility_divergence_score": F.col("macro_spy_vol_5d") - F.col("macro_spy_vol_20d")})
    df = df.withColumns({"financial_intermediation_stability_score": -c.mean("volatility_instability_pressure", 10), "systemic_instability_risk_score": c.mean("volatility_instability_pressure", 20) + c.mean("market_liquidity_fragility_index", 20), "liquidity_regime_shift_probability": expanding_rank("_li"), "structural_break_probability": expanding_rank("_z60")})
    df = df.withColumns({"intermediation_stress_probability": expanding_rank("systemic_instability_risk_score"), "regime_transition_risk": F.abs(c.diff("structural_break_probability"))})
    rets = bars.where(F.col("ticker").isin(*others.values())).select("ticker", "date", "close").withColumn("r", c.change("close"))
    for label, ticker in others.items():
        df = df.join(rets.where(F.col("ticker") == ticker).select("date", F.col("r").alias(f"macro_{label}_ret_1d")), "date", "left")
    return df.withColumn("cross_asset_pressure_index", c.zero("volatility_instability_pressure") - c.zero("macro_hyg_ret_1d") + c.zero("macro_vixy_ret_1d"))
