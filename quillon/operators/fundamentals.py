"""Fundamentals from statements: growth, margins, quality, sector ranks, composites; compensation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import columns as c


def growth(now: Column, before: Column) -> Column:
    return c.div(now - before, F.abs(before), 1e-12)


def statement_features(income: DataFrame, cash: DataFrame, balance: DataFrame) -> DataFrame:
    """From each instrument's newest statements; a year ago is the fifth newest. Fewer than two statements give no features."""
    w = Window.partitionBy("ticker").orderBy(F.col("period_end").desc())
    items = ("revenue", "gross_profit", "operating_income", "net_income", "eps", "ebitda")
    n = income.withColumn("_n", F.row_number().over(w)).where("_n <= 5")
    at = lambda x, k: F.max(F.when(F.col("_n") == k, F.col(x)))
    g = n.groupBy("ticker").agg(*[at(x, k).alias(f"{x}_{k}") for x in items for k in (1, 2, 3, 5)], F.count("*").alias("_k"), at("filing_date", 1).alias("fund_latest_filing_date"), at("period_end", 1).alias("fund_latest_period_end"))
    newest = lambda df, cols: df.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("ticker", *cols)
    g = g.join(newest(cash, ["operating_cf", "capex"]), "ticker", "left").join(newest(balance, ["total_assets", "total_equity", "cash", "debt_current", "debt_long"]), "ticker", "left").where("_k >= 2")
    margin = lambda x, k: F.when(F.col(f"revenue_{k}") > 0, F.col(f"{x}_{k}") / F.col(f"revenue_{k}"))
    rev = F.col("revenue_1")
    out = {f"fund_{x}_{p}": growth(F.col(f"{x}_1"), F.col(f"{x}_{k}")) for x in ("revenue", "eps", "ebitda") for p, k in (("qoq", 2), ("yoy", 5))}
    out |= {"fund_gross_margin": margin("gross_profit", 1), "fund_operating_margin": margin("operating_income", 1), "fund_net_margin": margin("net_income", 1), "fund_gross_margin_chg": margin("gross_profit", 1) - margin("gross_profit", 2), "fund_operating_margin_chg": margin("operating_income", 1) - margin("operating_income", 2)}
    out |= {
        "fund_revenue_acceleration": growth(rev, F.col("revenue_2")) - growth(F.col("revenue_2"), F.col("revenue_3")), "fund_fcf_quarterly": F.col("operating_cf") + F.col("capex"), "fund_earnings_quality": c.div("operating_cf", F.abs("net_income_1"), 1e-12),
        "fund_capex_intensity": F.when(rev > 0, F.abs("capex") / rev), "fund_net_debt": c.zero("debt_current") + c.zero("debt_long") - F.col("cash"), "fund_asset_turnover": F.when(F.col("total_assets") > 0, rev * 4 / F.col("total_assets")), "fund_equity_ratio": F.when(F.col("total_assets") > 0, F.col("total_equity") / F.col("total_assets")),
    }
    return g.select("ticker", "fund_latest_filing_date", "fund_latest_period_end", *[x.alias(k) for k, x in out.items()])


def ratio_features(ratios: DataFrame) -> DataFrame:
    return ratios.withColumns({"fund_fcf_yield": c.div("free_cash_flow", "market_cap", 1e-12), "fund_earnings_yield": c.div(F.lit(1.0), "fund_pe", 1e-12)})


#: Names of ratios that are better when low, and of those that are better when high.
CHEAP = ("fund_pe", "fund_ps", "fund_pb", "fund_ev_ebitda", "fund_pfcf", "fund_debt_equity")
GOOD = ("fund_roe", "fund_roa", "fund_gross_margin", "fund_operating_margin", "fund_earnings_quality", "fund_fcf_yield", "fund_revenue_yoy", "fund_eps_yoy", "fund_ebitda_yoy", "fund_revenue_acceleration")
#: Parts of rank names that a composite takes up: by substring, so that "pe" also finds the operating margin.
COMPOSITES = {"value": ("pe", "ps", "pb", "ev_ebitda", "pfcf"), "quality": ("roe", "roa", "gross_margin", "operating_margin", "earnings_quality"), "growth": ("revenue_yoy", "eps_yoy", "ebitda_yoy", "acceleration")}


def scored(df: DataFrame) -> DataFrame:
    """Sector ranks (cheap ascending, good descending), composites as means of the ranks that are known, growth at a price."""
    have = set(df.columns)
    df = df.withColumns({f"{x}_sector_rank": c.rank_share(x, "sector", descending=x in GOOD) for x in (*CHEAP, *GOOD) if x in have})
    ranks = [x for x in df.columns if x.endswith("_sector_rank")]
    for name, parts in COMPOSITES.items():
        if own := [F.col(x) for x in ranks if any(p in x for p in parts)]:
            df = df.withColumn(f"fund_{name}_composite", c.mean_of(*own))
    return df.withColumn("fund_garp_score", (1 - F.col("fund_value_composite")) * F.col("fund_growth_composite"))


def compensation(df: DataFrame, order: str | None = None) -> DataFrame:
    """Per company: total and mean pay, and the alignment score of the chief executive's equity share; 50 without one.

    A share at a bound of the score falls on either side by the last bit of its
    sums, and so by their order: with ``order``, a column that tells a company's
    rows apart, they are added up in it, however the rows are dealt out.
    """
    ceo = F.lower("position").rlike("chief executive|ceo")
    equity = c.zero("stock_awards") + c.zero("option_awards")
    parts = {"total_pay": F.col("total"), "_e": F.when(ceo, equity), "_t": F.when(ceo, F.col("total"))}
    if order is None:
        g = df.groupBy("ticker").agg(*[F.sum(x).alias(k) for k, x in parts.items()], F.avg("total").alias("mean_pay"))
    else:
        w = Window.partitionBy("ticker").orderBy(order).rowsBetween(*c.ALL)
        run = df.select("ticker", F.col(order).alias("_at"), *[F.sum(x).over(w).alias(k) for k, x in parts.items()], F.avg("total").over(w).alias("mean_pay"))
        g = run.groupBy("ticker").agg(*[F.max_by(k, "_at").alias(k) for k in (*parts, "mean_pay")])
    r = c.div("_e", "_t")
    score = F.when(F.col("_t").isNull(), 50).when(r > 0.8, 98).when(r > 0.6, 92).when(r > 0.4, 80).when(r > 0.2, 60).otherwise(40)
    return g.select("ticker", "total_pay", "mean_pay", r.alias("equity_ratio"), score.alias("alignment_score"))
