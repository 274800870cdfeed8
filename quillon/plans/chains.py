"""Queries of the jobs that chain the panel stages."""

from __future__ import annotations

from quillon import jobs
from quillon.config import UniverseThresholds
from quillon.operators import series
from quillon.plans import sql as s
from quillon.plans.series import LABELS, ou_levels
from quillon.plans.shape import RANK_LEVEL
from quillon.plans.technicals import rounded
from quillon.sources import sinks
from quillon.sources.panels import bars, reference_master

#: Of the weekly bars and account balances that stand for daily prices and market caps.
LIMITS = UniverseThresholds(price=900, average_volume=20, market_cap=100)  # leaves sectors of ten and more members
TODAY, TRAIN = "2001-12-01", "2000-12-31"
ELIGIBLE = f"m AS (SELECT ticker, avg(close) OVER {s.frame(22)} AS mc, avg(volume) OVER {s.frame(22)} AS mv, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars), chosen AS (SELECT ticker FROM m JOIN master USING (ticker) WHERE n = 1 AND mc >= {LIMITS.price} AND mv >= {LIMITS.average_volume} AND market_cap >= {LIMITS.market_cap}), inside AS (SELECT * FROM sbars WHERE ticker IN (FROM chosen))"
STRETCHES = [f"ou_{label}_stretch_{n}" for label, _ in LABELS.values() for n in series.OU_WINDOWS]
#: Of the stages that a query doesn't give: when they are read for the last time.
READ_LAST = {"universe_prices": ("research_prices", "reference_master", "integrity", "research_universe"), "transformed_panel": ("universe_prices",)}


def sources(spark, sf_dir):
    """Two overlapping sources of one and the same bars."""
    df = bars(spark, sf_dir)
    return [df.where("date < '1996-01-01'"), df.where("date >= '1995-01-01'")]


def active(spark, sf_dir):
    """Account balances stand for market caps; those that aren't positive would fail the check of the master."""
    return reference_master(spark, sf_dir).where("market_cap > 0")


def universe_job(spark, sf_dir):
    found = jobs.research_universe(sources(spark, sf_dir), active(spark, sf_dir), LIMITS, TODAY)
    return rounded(found["universe_prices"], ["close", "dollar_volume"], ("ticker", "date", "sector"))


def feature_job(spark, sf_dir):
    """Of the feature panel, the columns that the query gives are stored."""
    last = lambda name, df: jobs.shared(name, rounded(df, [*RANK_LEVEL, *STRETCHES], digits=4) if name == "feature_panel" else df)
    keep = jobs.passing(READ_LAST | {"feature_panel": ("transformed_panel",)}, last)
    found = jobs.research_universe(sources(spark, sf_dir), active(spark, sf_dir), LIMITS, TODAY, keep)
    return jobs.feature_panel(found["universe_prices"], keep)


def panel_job(spark, sf_dir):
    keep = jobs.passing(READ_LAST | {"normalised_panel": ("transformed_panel", "gmm_regimes")})
    found = jobs.panel(sources(spark, sf_dir), active(spark, sf_dir), LIMITS, TODAY, TRAIN, keep)
    return found["normalised_panel"].select("ticker", "date", "in_universe", "gmm_regime_label", "gmm_regime_confidence", "log_return_1d_pctrank", "log_return_1d_zscore")


QUERIES = {"job_research_universe": universe_job, "job_feature_panel": feature_job, "job_whole_panel": panel_job}
ORACLES = {
    "job_research_universe": f"WITH {s.BARS}, {ELIGIBLE} SELECT ticker, date, sector, {s.rounded('close')} AS close, {s.rounded('close * volume')} AS dollar_volume FROM inside",
    "job_feature_panel": s.chain(f"{s.BARS}, {ELIGIBLE}", *ou_levels(series.OU_FEATURES), RANK_LEVEL, start="inside", out=[*RANK_LEVEL, *STRETCHES], digits=4),
}
