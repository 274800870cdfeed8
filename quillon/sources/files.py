"""File sources: raw price folders, CSV series, nested JSON of market-data and filing services."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyarrow import parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import columns as c
from quillon.operators.universe import normalise_prices

AGGREGATES = "ticker string, results array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double,vw:double,n:double>>, status string"
CHAIN = "ticker string, asof string, results array<struct<details:struct<ticker:string,strike_price:double,contract_type:string,expiration_date:string>,greeks:struct<delta:double,gamma:double,theta:double,vega:double>,day:struct<volume:double>,open_interest:double,implied_volatility:double>>, next_url string"
OVERVIEW = "ticker string, status string, results struct<name:string,type:string,active:boolean,sic_code:string,sic_description:string,market_cap:double>"
NEWS = "ticker string, results array<struct<title:string,headline:string,name:string,published_utc:string,published_at:string,date:string>>"


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def raw_prices(spark: SparkSession, folder: str, kind: str = "parquet") -> DataFrame:
    """All per-instrument files of a folder in canonical columns; the file's name serves where it has no ticker.

    Files that can't be read are skipped; :func:`unreadable` lists them.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true")
    df = reader.option("header", "true").csv(folder) if kind == "csv" else reader.parquet(folder)
    return normalise_prices(df.withColumn("_file_name", stem(F.col("_metadata.file_path"))), F.upper(F.col("_file_name")))


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path in it; one without a scheme is local."""
    return arrow_fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (arrow_fs.LocalFileSystem(), path)


def unreadable(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """Those of ``paths``, files or folders of files, whose footers can't be read, with the error's first line; tasks open them."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                try:
                    where, own = opened(path)
                    folder = where.get_file_info(own).type == arrow_fs.FileType.Directory
                    names = [x.path for x in where.get_file_info(arrow_fs.FileSelector(own, recursive=True)) if x.is_file and x.base_name.endswith(".parquet")] if folder else [own]
                    for name in names:
                        parquet.read_metadata(name, filesystem=where)
                except Exception as e:  # noqa: BLE001  any failure to read is the finding
                    found.append((path, (str(e).splitlines() or [type(e).__name__])[0]))
            yield pd.DataFrame(found, columns=["path", "error"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 200)))
    return sorted(map(tuple, rows.mapInPandas(check, "path string, error string").collect()))


def instrument_files(df: DataFrame, folder: str, ticker: str = "ticker") -> int:
    """A Parquet file per instrument, named for it, without its column: the layout of a raw folder. Returns how many.

    An instrument's rows meet in one task, as they do in one file.
    """
    rest = [x for x in df.columns if x != ticker]

    def write(g: pd.DataFrame) -> pd.DataFrame:
        where, root = opened(folder)
        where.create_dir(root, recursive=True)
        name = str(g[ticker].iloc[0])
        parquet.write_table(pa.Table.from_pandas(g[rest], preserve_index=False), f"{root.rstrip('/')}/{name}.parquet", filesystem=where)
        return pd.DataFrame([(name,)], columns=["name"])

    return df.groupBy(ticker).applyInPandas(write, "name string").count()


def csv_series(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def bars_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Aggregate responses, one JSON object a line, to bars; epoch milliseconds become dates."""
    rows = spark.read.schema(AGGREGATES).json(path).where("status is null or status <> 'NOT_FOUND'").select("ticker", F.explode("results").alias("r"))
    return rows.select("ticker", F.to_date(F.timestamp_millis("r.t")).alias("date"), *[F.col(f"r.{k}").alias(n) for k, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)], F.col("r.vw").alias("vwap"), F.col("r.n").alias("transactions"))


def chain_from_json(spark: SparkSession, path: str, most: int = 2000) -> DataFrame:
    """Option-chain pages to one row per contract, at most ``most`` of a ticker and day (``asof``, null if it isn't given) in the order of its contract names."""
    rows = spark.read.schema(CHAIN).json(path).select("ticker", F.to_date("asof").alias("asof"), F.explode("results").alias("r"))
    flat = rows.select("ticker", "asof", F.col("r.details.ticker").alias("contract"), F.col("r.details.strike_price").alias("strike"), F.lower("r.details.contract_type").alias("contract_type"), F.to_date("r.details.expiration_date").alias("expiration"), "r.greeks.*", F.col("r.day.volume").alias("volume"), "r.open_interest", "r.implied_volatility")
    w = c.Window.partitionBy("ticker", "asof").orderBy("contract")
    return flat.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def overview_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Reference rows with their status: ``ok``, or ``not_found``."""
    df = spark.read.schema(OVERVIEW).json(path)
    kind = F.upper(F.coalesce("results.type", F.lit("")))
    return df.select("ticker", "results.name", "results.type", "results.active", "results.sic_code", "results.market_cap", (kind == "CS").alias("is_common_stock"), F.when(F.col("results").isNull() | (F.col("status") == "NOT_FOUND"), "not_found").otherwise("ok").alias("reference_status"))


def news_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Titles with times, each from the first of three names that has a value."""
    rows = spark.read.schema(NEWS).json(path).select("ticker", F.explode("results").alias("r"))
    return rows.select("ticker", F.coalesce("r.title", "r.headline", "r.name").alias("title"), F.coalesce("r.published_utc", "r.published_at", "r.date").alias("published"))


def statements_from_json(spark: SparkSession, path: str, items: tuple[str, ...]) -> DataFrame:
    """One row per statement with the named items as doubles, for :func:`quillon.operators.fundamentals.statement_features`."""
    fields = ", ".join(f"{x}:double" for x in items)
    rows = spark.read.schema(f"ticker string, results array<struct<period_end:string,filing_date:string,{fields.replace(' ', '')}>>").json(path).select("ticker", F.explode("results").alias("r"))
    return rows.select("ticker", F.to_date("r.period_end").alias("period_end"), F.to_date("r.filing_date").alias("filing_date"), *[F.col(f"r.{x}").alias(x) for x in items])


def compensation_from_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per officer, for :func:`quillon.operators.fundamentals.compensation`."""
    schema = "ticker string, results array<struct<position:string,total:double,stock_awards:double,option_awards:double>>"
    return spark.read.schema(schema).json(path).select("ticker", F.explode("results").alias("r")).select("ticker", "r.*")


def first_readable(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first path that exists, or None: an absent history is an empty one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(conf).exists(where):
            return spark.read.parquet(p)
    return None
