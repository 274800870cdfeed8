"""Option chains: open-interest ratios, pressure proxies and greek aggregates, by conditional aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import columns as c

EPS = 1e-12
#: Moneyness bands (strike / spot - 1) and buckets of days to expiry, both ends inclusive; they overlap.
BANDS = {"near_2pct": (-0.02, 0.02), "near_5pct": (-0.05, 0.05), "below_5pct": (-0.05, 0.0), "above_5pct": (0.0, 0.05), "below_10pct": (-0.10, 0.0), "above_10pct": (0.0, 0.10)}
BUCKETS = {"dte_0_7": (0, 7), "dte_8_30": (8, 30), "dte_31_90": (31, 90), "dte_91_180": (91, 180), "dte_181_plus": (181, 10_000)}


def prepared(chain: DataFrame) -> DataFrame:
    """Types and derived columns; contracts without a strike are left out. Needs ``spot`` and ``asof``."""
    df = chain.where("strike is not null").withColumns({"contract_type": F.lower(F.trim("contract_type")), "open_interest": c.zero("open_interest"), "volume": c.zero("volume")})
    return df.withColumns({"mny": F.col("strike") / F.col("spot") - 1, "dte": F.datediff("expiration", "asof")})


def amount(x: str | Column, kind: str, where: Column | None = None) -> Column:
    hit = F.col("contract_type") == kind
    return c.zero(F.sum(F.when(hit if where is None else hit & where, c.col(x))))


def ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > EPS, a / b).otherwise(0.0)


def ratios(chain: DataFrame, keys: tuple[str, ...] = ("ticker", "asof")) -> DataFrame:
    """Put and call shares of open interest and put/call ratios, for all contracts and for each band and bucket."""
    slices = {"all": F.lit(True)} | {k: F.col("mny").between(*b) for k, b in BANDS.items()} | {k: F.col("dte").between(*b) for k, b in BUCKETS.items()}
    sums = [amount(x, kind, where).alias(f"_{kind}_{x}_{k}") for k, where in slices.items() for x in ("open_interest", "volume") for kind in ("call", "put")]
    df = prepared(chain).groupBy(*keys).agg(*sums)
    out = {}
    for k in slices:
        call, put, cv, pv = (F.col(f"_{kind}_{x}_{k}") for x in ("open_interest", "volume") for kind in ("call", "put"))
        out |= {f"put_share_oi_{k}": ratio(put, call + put), f"call_share_oi_{k}": ratio(call, call + put), f"pcr_oi_{k}": ratio(put, call), f"pcr_vol_{k}": ratio(pv, cv)}
    return df.select(*keys, *[x.alias(k) for k, x in out.items()])


def pressure(chain: DataFrame, keys: tuple[str, ...] = ("ticker", "asof"), near: float = 0.05, days: int = 7, coverage: float = 0.60, eps: float = EPS) -> DataFrame:
    """Near-spot and near-expiry pressure; greeks where they cover enough contracts and interest, else interest over time."""
    df = prepared(chain).where("dte is null or dte >= 0")
    inside, soon = F.abs("mny") <= near, F.col("dte") <= days
    decay = 1 / F.sqrt(F.when(F.col("dte") == 0, 0.5).otherwise(F.coalesce("dte", F.lit(days)).cast("double")))
    oi, gamma = F.col("open_interest"), F.col("gamma")
    weighted = gamma * oi * decay
    g = df.groupBy(*keys).agg(
        *[amount(x, k).alias(f"_{k}_{y}") for k in ("call", "put") for x, y in (("volume", "vol"), ("open_interest", "oi"))],
        *[amount(oi, k, inside).alias(f"_{k}_near") for k in ("call", "put")], *[amount(oi * decay, k, soon).alias(f"_{k}_soon") for k in ("call", "put")],
        *[amount(weighted, k, inside & gamma.isNotNull()).alias(f"_{k}_gamma") for k in ("call", "put")], *[amount(oi * decay, k, inside).alias(f"_{k}_decay") for k in ("call", "put")],
        F.count_if(inside).alias("_n"), F.count_if(inside & gamma.isNotNull()).alias("_ng"), c.zero(F.sum(F.when(inside, oi))).alias("_oi"), c.zero(F.sum(F.when(inside & gamma.isNotNull(), oi))).alias("_oig"),
        c.zero(F.sum(F.when(soon, F.abs(c.zero("theta")) * oi))).alias("_th"), c.zero(F.sum(F.when(soon, oi * decay))).alias("_thp"), c.zero(F.sum(F.when(soon, oi))).alias("_so"), F.count_if(soon & F.col("theta").isNotNull()).alias("_nth"),
        c.zero(F.avg("implied_volatility")).alias("opt_iv_mean"), F.count("*").cast("double").alias("contracts_processed"),
    )
    covered = (F.col("_ng") > 0) & (F.col("_ng") / F.col("_n") >= coverage) & (F.col("_oig") / (F.col("_oi") + eps) >= coverage)
    g = g.withColumns({f"_{k}_g": F.when(covered, F.col(f"_{k}_gamma")).otherwise(F.col(f"_{k}_decay")) for k in ("call", "put")})
    even = lambda a, b: (F.col(a) - F.col(b)) / (F.abs(a) + F.abs(b) + eps)
    return g.select(
        *keys, F.col("_call_vol").alias("opt_call_vol"), F.col("_put_vol").alias("opt_put_vol"), (F.col("_put_vol") / (F.col("_call_vol") + eps)).alias("opt_put_call_vol_ratio"), F.col("_call_oi").alias("opt_call_oi"), F.col("_put_oi").alias("opt_put_oi"), (F.col("_put_oi") / (F.col("_call_oi") + eps)).alias("opt_put_call_oi_ratio"),
        F.col("_call_soon").alias("opt_near_expiry_call_pressure"), F.col("_put_soon").alias("opt_near_expiry_put_pressure"), even("_call_near", "_put_near").alias("opt_strike_pressure_near_spot"), even("_call_g", "_put_g").alias("gamma_proxy"),
        (F.when(F.col("_nth") > 0, F.col("_th")).otherwise(F.col("_thp")) / (F.col("_so") + eps)).alias("theta_pressure"), "opt_iv_mean", "contracts_processed",
    )


def flatten(nested: DataFrame) -> DataFrame:
    """Records with ``details``, ``greeks`` and ``day`` to one row per contract."""
    return nested.select("ticker", "asof", "spot", F.col("details.strike_price").alias("strike"), F.col("details.contract_type").alias("contract_type"), "greeks.delta", "greeks.gamma", "greeks.theta", "greeks.vega", F.col("day.volume").alias("volume"), "open_interest", F.col("implied_volatility"))


def aggregate(chain: DataFrame, keys: tuple[str, ...] = ("ticker", "asof")) -> DataFrame:
    """Totals, ratios, interest-weighted volatility, net greeks per 100 shares, and the strike with most interest (of equals the lowest)."""
    df = chain.withColumns({"contract_type": F.lower("contract_type"), "open_interest": c.zero("open_interest"), "volume": c.zero("volume")}).where("contract_type in ('call', 'put')")
    oi, iv, spot = F.col("open_interest"), F.col("implied_volatility"), F.col("spot")
    kind = lambda k: F.col("contract_type") == k
    weighed = lambda k: F.coalesce(c.div(F.sum(F.when(kind(k) & (oi > 0), iv * oi)), F.sum(F.when(kind(k) & (oi > 0) & iv.isNotNull(), oi))), F.avg(F.when(kind(k), iv)))
    sign = F.when(kind("call"), 1).otherwise(-1)
    g = df.groupBy(*keys).agg(
        *[F.count_if(kind(k)).alias(f"num_{k}_contracts") for k in ("call", "put")], *[amount("open_interest", k).alias(f"total_{k}_oi") for k in ("call", "put")], *[amount("volume", k).alias(f"total_{k}_volume") for k in ("call", "put")],
        weighed("call").alias("avg_iv_calls"), weighed("put").alias("avg_iv_puts"), *[c.zero(F.sum(F.col(x) * oi * 100)).alias(f"net_{x}") for x in ("delta", "gamma", "theta", "vega")],
        c.zero(F.sum(sign * F.col("gamma") * oi * 100 * spot)).alias("gex"), c.zero(F.sum(F.col("delta") * oi * 100 * spot)).alias("dex"), F.max("spot").alias("spot_price"),
    )
    strikes = df.where("strike is not null").groupBy(*keys, "strike").agg(F.sum("open_interest").alias("o"))
    top = strikes.groupBy(*keys).agg(F.max_by("strike", F.struct("o", -F.col("strike"))).alias("max_pain_strike"))
    out = g.join(top, list(keys), "left")
    return out.withColumns({"pc_ratio_oi": c.div("total_put_oi", "total_call_oi"), "pc_ratio_volume": c.div("total_put_volume", "total_call_volume"), "iv_skew": F.col("avg_iv_puts") - F.col("avg_iv_calls")})
