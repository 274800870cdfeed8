"""Regime runs and transitions, regime scores, and the multi-signal summary with its commentary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import columns as c
from quillon.operators.quantiles import exact_quantiles

HORIZONS = (20, 60, 90)
#: Scores of market stress states, and weights of the signals by horizon.
STATE_SCORES = {"GREEN": 0.50, "YELLOW": 0.10, "ORANGE": -0.35, "RED": -0.80}
WEIGHTS = {
    20: {"stock": 0.32, "macro": 0.16, "sector": 0.22, "tech": 0.25, "vdce": 0.05},
    60: {"stock": 0.34, "macro": 0.24, "sector": 0.17, "tech": 0.20, "vdce": 0.05},
    90: {"stock": 0.30, "macro": 0.34, "sector": 0.16, "tech": 0.15, "vdce": 0.05},
}
#: What regimes are scored by, and what the summary reads of an instrument's latest row.
SCORED = ("log_return_1d", "realized_vol_20", "drawdown_60", "stretch")
TECHNICAL = ("price_vs_sma20", "rsi_14", "ret_20d_back", "ret_60d_back", "ret_90d_back", "breakout_20d_high_flag", "breakdown_20d_low_flag", "sma20_slope_5", "ema10_slope_5", "realized_vol_20", "dist_from_20d_high")


def runs(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Consecutive rows of one instrument in one regime; rows without a regime are left out first."""
    known = df.where(F.col(regime).isNotNull())
    change = F.when(F.coalesce(c.lag(regime) == F.col(regime), F.lit(False)), 0).otherwise(1)
    known = known.withColumn("_change", change).withColumn("_run", F.sum("_change").over(c.series().rowsBetween(*c.ALL)))
    out = known.groupBy("ticker", "_run", regime).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("duration_rows"))
    return out.withColumn("duration_calendar_days", F.datediff("end_date", "start_date") + 1).drop("_run")


def run_summary(r: DataFrame, regime: str = "regime") -> DataFrame:
    d, k = F.col("duration_rows"), F.col("duration_calendar_days")
    return r.groupBy(regime).agg(F.count("*").alias("n_runs"), F.avg(d).alias("mean_duration_rows"), F.median(d).alias("median_duration_rows"), F.percentile(d, 0.9).alias("p90_duration_rows"), F.max(d).alias("max_duration_rows"), F.avg(k).alias("mean_calendar_days"), F.median(k).alias("median_calendar_days"), F.max(k).alias("max_calendar_days"))


def transitions(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Counts of changes from one regime to another, and their share among the changes from it."""
    known = df.where(F.col(regime).isNotNull()).withColumn("to_regime", c.lag(regime, -1)).where(f"to_regime is not null and to_regime <> {regime}")
    out = known.groupBy(F.col(regime).alias("from_regime"), "to_regime").agg(F.count("*").alias("transition_count"))
    return out.withColumn("transition_prob", F.col("transition_count") / F.sum("transition_count").over(Window.partitionBy("from_regime")))


def rank_all(x: str) -> Column:
    """Percentile rank over a table of a few rows."""
    return c.rank_share(x, "_one")


def regime_scores(df: DataFrame, regime: str = "regime") -> DataFrame:
    """(regime, ``score``): ranks of four medians, blended; higher volatility ranks lower. A row per regime.

    Medians are exact and found by brackets, all of them in the same passes, so
    that no task holds a regime's values; ``df`` is read in each: store it first.
    Regimes are few; their list reaches the driver.
    """
    names = SCORED
    known = df.where(F.col(regime).isNotNull()).select(regime, *names)
    found = [r[0] for r in known.select(regime).distinct().orderBy(regime).collect()]
    each = known.select(*[F.when(F.col(regime) == r, F.col(x)).alias(f"_{k}_{x}") for k, r in enumerate(found) for x in names])
    q = exact_quantiles(each, {x: [0.5] for x in each.columns}) if found else {}
    rows = [(r, *[q[f"_{k}_{x}"][0] or 0.0 for x in names], 1) for k, r in enumerate(found)]
    schema = T.StructType([df.schema[regime], *[T.StructField(f"m_{x}", T.DoubleType()) for x in names], T.StructField("_one", T.IntegerType())])
    medians = df.sparkSession.createDataFrame(rows, schema)
    blend = 0.35 * rank_all("m_log_return_1d") + 0.25 * (1 - rank_all("m_realized_vol_20")) + 0.25 * rank_all("m_drawdown_60") + 0.15 * rank_all("m_stretch")
    return medians.select(regime, ((blend - 0.5) * 2).alias("score"))


def label_of(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 0.45, "risk_on").when(score >= 0.15, "constructive").when(score > -0.15, "neutral").when(score > -0.45, "caution").otherwise("risk_off")


def state_score(state: Column) -> Column:
    out = F.lit(0.0)
    for k, v in STATE_SCORES.items():
        out = F.when(F.upper(state) == k, v).otherwise(out)
    return out


def calibration_quality(brier: Column) -> Column:
    """From a Brier score; 0.70 where there is none."""
    return F.coalesce(c.clip(1 - brier / 0.10, 0.50, 0.98), F.lit(0.70))


def latest_z(x: str, n: int = 252, least: int = 20) -> Column:
    """The last row's deviation over the last ``n`` rows; 0 for too few or constant ones."""
    own = c.frame(n)
    return F.when(F.count(x).over(own) >= least, c.zero(c.div(F.col(x) - F.avg(x).over(own), F.stddev_samp(x).over(own), 1e-12))).otherwise(0.0)


def macro_score(df: DataFrame, regime_score: Column) -> DataFrame:
    lean = lambda x, scale: F.tanh(c.zero(x) / scale)
    score = c.clip(0.55 * regime_score + 0.20 * lean("macro_spy_mom_20d", 0.10) - 0.15 * F.tanh((c.zero("volatility_instability_pressure") - 1) / 0.40) - 0.10 * lean("cross_asset_pressure_index", 0.75), -1, 1)
    return df.withColumn("macro_regime_score", score).withColumn("macro_regime_label", label_of(F.col("macro_regime_score")))


def summary(df: DataFrame, quality: dict[int, float] | None = None) -> DataFrame:
    """Horizon scores, labels, confidences and commentary from the signals of each instrument's latest row.

    Missing inputs count as neutral: 50 for RSI, 0.50 for a probability, 1 for a multiplier, 0 for the rest.
    """
    quality = {h: 0.70 for h in HORIZONS} | (quality or {})
    lean = lambda x, scale: c.zero(F.tanh(F.col(x) / scale))
    sector = 0.45 * lean("sector_relative_strength_20d", 0.05) + 0.35 * (0.50 - F.coalesce("sector_vol_prob", F.lit(0.50))) + 0.20 * (F.coalesce("sector_risk_multiplier", F.lit(1.0)) - 1)
    df = df.withColumns({
        "sector_signal": c.clip(sector, -1, 1),
        "tech_signal_20d": c.clip(0.30 * lean("price_vs_sma20", 0.05) + 0.20 * (F.coalesce("rsi_14", F.lit(50.0)) - 50) / 50 + 0.20 * lean("ret_20d_back", 0.12) + 0.15 * c.zero("breakout_20d_high_flag") - 0.15 * c.zero("breakdown_20d_low_flag"), -1, 1),
        "tech_signal_60d": c.clip(0.35 * lean("ret_60d_back", 0.20) + 0.20 * lean("sma20_slope_5", 0.05) + 0.20 * lean("ema10_slope_5", 0.05) + 0.10 * lean("price_vs_sma20", 0.05) - 0.15 * lean("realized_vol_20", 0.08), -1, 1),
        "tech_signal_90d": c.clip(0.45 * lean("ret_90d_back", 0.25) + 0.20 * lean("ret_60d_back", 0.20) + 0.15 * lean("dist_from_20d_high", 0.10) - 0.20 * lean("realized_vol_20", 0.08), -1, 1),
        "vdce_signal": c.clip(F.col("vdce_signal") - 0.20 * lean("vdce_leader_score", 0.10), -1, 1),
    })
    parts = {"stock": "stock_regime_signal", "macro": "macro_regime_score", "sector": "sector_signal", "vdce": "vdce_signal"}
    for h in HORIZONS:
        own = parts | {"tech": f"tech_signal_{h}d"}
        score = c.clip(sum((WEIGHTS[h][k] * c.zero(x) for k, x in own.items()), F.lit(0.0)), -1, 1)
        covered = sum((F.col(own[k]).isNotNull().cast("int") for k in ("stock", "macro", "sector", "tech")), F.lit(0)) / 4
        df = df.withColumn(f"regime_{h}d_score", score)
        df = df.withColumns({f"regime_{h}d_label": label_of(F.col(f"regime_{h}d_score")), f"regime_{h}d_confidence": c.clip((0.38 + 0.42 * F.abs(f"regime_{h}d_score") + 0.20 * covered) * quality[h], 0.20, 0.99)})
        df = df.withColumn(f"regime_{h}d_commentary", commentary(h))
    return df


def commentary(h: int) -> Column:
    """The three strongest drivers as phrases; of equally strong ones the first named.

    Fixed values: the phrases.
    """
    def phrase(k: int, x: str, up: Column, down: Column, least: float = -1.0) -> Column:
        s = F.col(x)
        return F.when(s.isNotNull() & (F.abs(s) > least), F.struct((-F.abs(s)).alias("w"), F.lit(k).alias("k"), F.when(s >= 0, up).otherwise(down).alias("t")))

    t = F.lit
    macro = F.concat(t("macro backdrop is "), F.coalesce("macro_regime_label", t("mixed")))
    state = lambda way: F.concat(t(f"market stress is {way} ("), F.coalesce("vdce_market_state", t("n/a")), t(")"))
    all_ = F.array(
        phrase(0, "stock_regime_signal", t("stock regime profile is constructive"), t("stock regime profile is defensive")), phrase(1, "macro_regime_score", macro, macro),
        phrase(2, "sector_signal", t("sector leadership is supportive"), t("sector leadership is deteriorating")), phrase(3, f"tech_signal_{h}d", t("trend and momentum are aligned"), t("trend and momentum are soft")),
        phrase(4, "vdce_signal", state("contained"), state("elevated"), 0.05),
    )
    top = F.slice(F.array_sort(F.filter(all_, lambda x: x.isNotNull())), 1, 3)
    head = F.concat(t(f"{h}d regime is "), F.replace(F.col(f"regime_{h}d_label"), t("_"), t(" ")))
    return F.when(F.size(top) == 0, F.concat(head, t(" with limited supporting context."))).otherwise(F.concat(head, t("; "), F.array_join(F.transform(top, lambda x: x["t"]), "; "), t(".")))
