"""Panels from the driver's tables: weekly bars per supplier, ticks from events, dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task takes of an input, so that its sorts stay within memory however many instruments there are.
ROWS_A_TASK = 200_000


def dealt(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """``df`` by ``keys``, in a number of tasks that grows with its rows; small tables get what the session sets.

    The count reads a Parquet table's footers and the columns of its filters.
    ``like`` is counted in place of a table that would have to be computed for it.
    """
    n = -(-(df if like is None else like).count() // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def reference_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``ticker``, ``name``, ``market_cap``, ``industry``, ``sector``) of each supplier; nation and region have fixed, tiny sizes."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    both = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"], "left").join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left")
    return both.select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("market_cap"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))


def bars(spark: SparkSession, sf_dir: str, sectors: bool = False) -> DataFrame:
    """Weekly bars, dealt out by instrument before they are made: the row windows over them stand on the same exchange and order.

    An instrument's rows of a week lie far apart in the table, so that aggregating before the exchange would save next to nothing.
    """
    l = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0)  # noqa: E741
    l = dealt(l.withColumns({"ticker": F.col("l_suppkey").cast("string"), "date": F.to_date(F.date_trunc("week", "l_shipdate"))}), "ticker")  # noqa: E741
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    out = l.groupBy("ticker", "date").agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"), F.count("*").cast("double").alias("transactions"),
    )
    if sectors:
        # One row per instrument: the optimizer broadcasts it while it is small and joins by shuffle beyond.
        out = out.join(reference_master(spark, sf_dir).select("ticker", "sector", "industry", "market_cap"), "ticker", "left")
    return out


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from events: user as ticker, ``value`` as price, ``props.k`` as size; views stand for off-exchange."""
    e = table(spark, sf_dir, "events")
    size = F.from_json("props", "k double")["k"]
    return e.select(
        F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date"), "ts", F.date_trunc("minute", "ts").alias("minute"), "event_id",
        F.col("value").alias("trade_price"), size.alias("trade_size"), (F.col("value") * size).alias("trade_notional"),
        F.when(F.col("event_type") == "view", 1.0).otherwise(0.0).alias("off_exchange_flag"), F.when(F.col("event_type") == "view", 0.0).otherwise(1.0).alias("lit_exchange_flag"),
    )


def index_bars(panel: DataFrame, ticker: str = "IDX") -> DataFrame:
    """One bar per date over all instruments, as an instrument of its own."""
    means = {x: F.avg(x).alias(x) for x in ("open", "close", "vwap")}
    return panel.groupBy("date").agg(means["open"], F.max("high").alias("high"), F.min("low").alias("low"), means["close"], F.sum("volume").alias("volume"), means["vwap"], F.sum("transactions").alias("transactions")).withColumn("ticker", F.lit(ticker))


def sector_closes(panel: DataFrame) -> DataFrame:
    """(``label``, ``date``, ``close``): the mean close of each sector, a stand-in for macro proxies."""
    return panel.where("sector is not null").groupBy(F.lower(F.col("sector")).alias("label"), "date").agg(F.avg("close").alias("close"))
