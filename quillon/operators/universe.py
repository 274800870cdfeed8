"""Ingest, data quality, universe building, joins and set operations on panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANONICAL = ("ticker", "date", "open", "high", "low", "close", "volume", "vwap", "transactions")
#: Logical names with the names that sources use for them, first match first.
ALIASES = {
    "ticker": ("ticker", "symbol", "sym", "stock", "name", "permno", "id"),
    "date": ("date", "trade_date", "dt", "timestamp", "asofdate"),
    "close": ("close", "adj_close", "adjusted_close", "price", "px", "prc", "adjprc", "adj_price"),
    "close_unadj": ("close_unadj", "unadjusted_close", "raw_close", "rawprc", "unadj_close", "prcraw"),
    "volume": ("volume", "vol", "trading_volume", "shares_traded"),
    "sector": ("sector", "gics_sector", "sect", "sector_name"),
    "industry": ("industry", "gics_industry", "industry_name", "indgrp", "industry_group"),
    "mkt_cap": ("mkt_cap", "market_cap", "marketcap", "cap", "market_value"),
}
MISSING = ("", "nan", "None", "<NA>")


class QualityError(ValueError):
    """A hard check on a panel failed."""


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    if gone := sorted(set(columns) - set(df.columns)):
        raise QualityError(f"missing columns: {', '.join(gone)}")
    return df


def detect_columns(df: DataFrame) -> dict[str, str]:
    """Logical name to the column of ``df`` that serves it; names are compared in lower case, blanks as underscores."""
    have = {x.strip().lower().replace(" ", "_"): x for x in df.columns}
    return {name: have[a] for name, aliases in ALIASES.items() if (a := next((a for a in aliases if a in have), None))}


def clean_text(c: Column | str) -> Column:
    """Trimmed; the spellings of a missing value are NULL."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~c.isin(*MISSING), c)


def standardise(df: DataFrame) -> DataFrame:
    """Columns by their logical names, with types: upper-case tickers, dates, doubles; what doesn't parse is NULL."""
    found = detect_columns(df)
    number = lambda c: F.col(c).try_cast("double")
    kinds = {"ticker": lambda c: F.upper(clean_text(c)), "date": lambda c: F.to_date(F.col(c).try_cast("timestamp"))} | dict.fromkeys(("close", "close_unadj", "volume", "mkt_cap"), number)
    return df.select(*[kinds.get(name, clean_text)(c).alias(name) for name, c in found.items()])


def normalise_prices(df: DataFrame, ticker: Column | None = None) -> DataFrame:
    """Canonical columns in canonical order: lower-case names, a missing ticker from ``ticker``, missing ones NULL."""
    df = df.toDF(*[x.strip().lower() for x in df.columns])
    if "ticker" not in df.columns:
        df = df.withColumn("ticker", F.lit(None).cast("string") if ticker is None else ticker)
    text, typed = {"ticker"}, {"date"}
    return df.select(*[(F.col(x) if x in df.columns else F.lit(None)).cast("string" if x in text else "date" if x in typed else "double").alias(x) for x in CANONICAL])


def clean_keys(df: DataFrame) -> DataFrame:
    out = df.withColumns({"ticker": F.upper(F.trim("ticker")), "date": F.to_date(F.col("date").try_cast("timestamp"))})
    return out.where("ticker is not null and ticker <> '' and date is not null")


def keep_last(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """One row per key, the last by ``order``; the order must be total for the result to be one and the same."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_sources(*sources: DataFrame, keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """Union by name; where sources overlap on a key, the later one wins."""
    tagged = [df.withColumn("_source", F.lit(k)) for k, df in enumerate(sources)]
    return keep_last(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), keys, F.col("_source")).drop("_source")


def upsert(history: DataFrame, fresh: DataFrame, keys: tuple[str, ...], replace_date: bool = False) -> DataFrame:
    """History with today's snapshot: rows with an equal key, or with ``replace_date`` of an equal date, are replaced."""
    if replace_date:
        history = history.join(fresh.select("date").distinct(), "date", "left_anti").select(history.columns)
        return history.unionByName(fresh, allowMissingColumns=True)
    return merge_sources(history, fresh, keys=keys)


def bad_close(df: DataFrame, policy: str) -> DataFrame:
    """``drop`` or ``null`` rows whose close isn't positive, or ``fail`` on any; a negative volume always fails."""
    bad = F.col("close").isNull() | (F.col("close") <= 0)
    if df.where(F.col("volume") < 0).limit(1).count():
        raise QualityError("negative volume")
    if policy == "drop":
        return df.where(~bad)
    if policy == "null":
        return df.withColumn("close", F.when(~bad, F.col("close")))
    if df.where(bad).limit(1).count():
        raise QualityError("close is missing or not positive")
    return df


def as_bool(c: Column | str) -> Column:
    """From booleans, numbers and their spellings; anything else is false."""
    text = F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))
    return F.coalesce(text.isin("1", "true", "t", "yes", "y") | (text.try_cast("double") > 0), F.lit(False))


def liquid(df: DataFrame, price: float, volume: float, rows: int = 22) -> DataFrame:
    """Instruments whose last ``rows`` rows are there, with last close and mean volume at or above the limits."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    last = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows)
    out = last.groupBy("ticker").agg(F.max_by("close", "date").alias("last_close"), F.avg("volume").alias("avg_volume"), F.count("*").alias("n_rows"))
    return out.where((F.col("last_close") >= price) & (F.col("avg_volume") >= volume) & (F.col("n_rows") >= rows))


def eligible(df: DataFrame, reference: DataFrame, price: float, volume: float, cap: float, rows: int = 22) -> DataFrame:
    """Reference rows whose latest rolling means pass, and whose market cap, from the reference or else the panel, does."""
    own = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(rows - 1), 0)
    latest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    stats = df.select("ticker", "date", F.avg("close").over(own).alias("mean_close"), F.avg("volume").over(own).alias("mean_volume")).withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    both = reference.join(stats.select("ticker", "mean_close", "mean_volume"), "ticker", "left")
    passed = (F.col("mean_close") >= price) & (F.col("mean_volume") >= volume) & (F.col("market_cap") >= cap)
    return both.withColumn("eligible", F.coalesce(passed, F.lit(False)))


def resolve_sector(df: DataFrame) -> DataFrame:
    """Fills a missing sector from the instrument's only one; more than one is a conflict and fills nothing."""
    w = Window.partitionBy("ticker")
    kinds = F.size(F.collect_set("sector").over(w))
    return df.withColumns({"sector_conflict": kinds > 1, "sector_resolved": F.coalesce("sector", F.when(kinds == 1, F.max("sector").over(w)))})


def modal_sector(df: DataFrame, since: str) -> DataFrame:
    """(``ticker``, ``gics_sector``): the most frequent sector from a date on, the smallest of equally frequent ones."""
    return df.where((F.col("date") >= since) & F.col("sector").isNotNull()).groupBy("ticker").agg(F.mode("sector", True).alias("gics_sector"))


def integrity(df: DataFrame, reference: DataFrame, today: str) -> DataFrame:
    """(``check``, ``severity``, ``n``, ``examples``): at most 50 tickers stand for the rows that fail."""
    def report(name: str, severity: str, rows: DataFrame) -> DataFrame:
        first = lambda tickers: F.slice(F.array_sort(tickers), 1, 50)
        # In two steps, so that no task holds all failing tickers.
        parts = rows.groupBy(F.pmod(F.xxhash64("ticker"), F.lit(1000))).agg(F.count("*").alias("n"), first(F.collect_set("ticker")).alias("few"))
        return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), first(F.flatten(F.collect_list("few"))).alias("examples")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n", "examples")

    keys = df.groupBy("ticker", "date").agg(F.count("*").alias("c")).where("c > 1").select("ticker")
    missing = df.select("ticker").distinct().join(reference.select("ticker"), "ticker", "left_anti")
    checks = [
        ("duplicate_keys", "fail", keys), ("future_dates", "fail", df.where(F.col("date") > today)), ("missing_in_reference", "warn", missing),
        ("ok_without_cap", "fail", reference.where("market_cap is null")), ("cap_not_positive", "fail", reference.where("market_cap <= 0")),
        ("without_sector", "warn", reference.where("sector is null")), ("without_industry", "warn", reference.where("industry is null")),
    ]
    return reduce(DataFrame.unionByName, [report(*x) for x in checks])


def unique_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join that fails unless the right keys, and for ``1:1`` the left ones, are unique."""
    for df in (right, left) if validate == "1:1" else (right,):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise QualityError(f"{key} isn't unique ({validate})")
    return left.join(right, key, how)


#: Ranges of industry codes by sector; the first sector with a range that holds a code wins.
CODE_SECTORS = {
    "Energy": ((1300, 1389), (2900, 2999), (4600, 4699)),
    "Materials": ((1000, 1299), (1400, 1499), (2400, 2499), (2600, 2699), (2800, 2829), (2840, 2899), (3000, 3099), (3200, 3399)),
    "Industrials": ((1500, 1799), (3400, 3599), (3700, 3719), (3720, 3799), (3900, 3999), (4000, 4299), (4400, 4599), (4700, 4799), (8710, 8719), (8740, 8749)),
    "Consumer Discretionary": ((2500, 2599), (3100, 3199), (3710, 3716), (5000, 5199), (5200, 5399), (5500, 5599), (5600, 5699), (5700, 5799), (5800, 5899), (7000, 7299), (7800, 7829), (8200, 8299)),
    "Consumer Staples": ((2000, 2199), (5400, 5499), (5900, 5999)),
    "Health Care": ((2830, 2836), (3841, 3851), (5047, 5049), (8000, 8099), (8730, 8734)),
    "Financials": ((6000, 6199), (6200, 6299), (6300, 6499), (6700, 6799)),
    "Real Estate": ((6500, 6599),),
    "Information Technology": ((3600, 3659), (3670, 3699), (3800, 3840), (7370, 7379), (7372, 7374), (3570, 3579)),
    "Communication Services": ((4800, 4899), (2700, 2799), (3660, 3669), (7830, 7899), (7900, 7999)),
    "Utilities": ((4900, 4999),),
}


def code_sector(code: Column | str) -> Column:
    """Sector of an industry code; ``Unknown`` for what isn't a number or in no range."""
    c = (F.col(code) if isinstance(code, str) else code).try_cast("int")
    out = F.when(c.isNull(), "Unknown")
    for name, ranges in CODE_SECTORS.items():
        out = out.when(reduce(Column.__or__, [c.between(low, high) for low, high in ranges]), name)
    return out.otherwise("Unknown")


def required_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(``required``, ``present``, ``missing_rows``) in one pass over the rows."""
    there = set(df.columns)
    counts = df.agg(*[F.count(F.when(F.col(x).isNull() if x in there else F.lit(True), 1)).alias(f"n{k}") for k, x in enumerate(names)])
    each = F.array(*[F.struct(F.lit(x).alias("required"), F.lit(x in there).alias("present"), F.col(f"n{k}").alias("missing_rows")) for k, x in enumerate(names)])
    return counts.select(F.inline(each))


def business_days(start: Column, end: Column) -> Column:
    """Week days from ``start`` up to, not including, ``end``."""
    def before(day: Column) -> Column:
        """Week days since a Monday, in whole weeks and the rest."""
        days = F.datediff(day, F.lit("1970-01-05"))
        return 5 * F.floor(days / 7) + F.least(F.pmod(days, F.lit(7)), F.lit(5))

    return F.when(end > start, (before(end) - before(start)).cast("int")).otherwise(0)
