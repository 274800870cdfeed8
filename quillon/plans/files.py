"""Queries that write files of the driver's tables into the shared folder and read them back."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import fundamentals
from quillon.operators import universe as u
from quillon.plans import sql as s
from quillon.plans.technicals import rounded
from quillon.sources import files, paged, sinks
from quillon.sources.panels import bars, table
from quillon.streaming import backfill

Q, O = {}, {}
R = s.rounded


def add(name: str, oracle: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle is not None:
            O[name] = oracle
        return f

    return keep


B = f"WITH {s.BARS}"
KEYS = ("ticker", "date")


def json_of(spark, df, path: str) -> str:
    df.write.json(path)
    return path


@add("k01_parquet_overwrite", f"{B} SELECT ticker, date, {R('close')} AS close FROM bars")
def parquet_overwrite(spark, sf_dir):
    path, b = sinks.scratch(spark), bars(spark, sf_dir).select("ticker", "date", "close")
    sinks.parquet(b.limit(0), path)
    sinks.parquet(b, path)
    return rounded(spark.read.parquet(path), ["close"])


@add("k02_s04_csv_snapshot", f"{B} SELECT ticker, date, {R('close')} AS close FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
def csv_snapshot(spark, sf_dir):
    path = sinks.scratch(spark)
    latest = u.keep_last(bars(spark, sf_dir), ("ticker",), F.col("date"))
    sinks.csv(latest.select("ticker", "date", "close"), path)
    return rounded(files.csv_series(spark, path, "ticker string, date date, close double"), ["close"])


@add("k05_s25_status", f"{B} SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, min(date)::VARCHAR AS first, max(date)::VARCHAR AS last FROM bars")
def status(spark, sf_dir):
    path = sinks.scratch(spark)
    one = bars(spark, sf_dir).agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("tickers"), F.min("date").alias("first"), F.max("date").alias("last"))
    sinks.status(one, path, job="bars")
    return spark.read.schema("rows long, tickers long, first string, last string").json(path)


@add("k06_model_files", f"{B}, m AS (SELECT avg(close) AS a, stddev_samp(close) AS sd FROM bars) SELECT ticker, date, {R('(close - a) / sd')} AS scaled FROM bars, m")
def model_files(spark, sf_dir):
    path = sinks.scratch(spark)
    rows = VectorAssembler(inputCols=["close"], outputCol="x").transform(bars(spark, sf_dir))
    sinks.model(StandardScaler(inputCol="x", outputCol="y", withMean=True).fit(rows), path)
    out = StandardScalerModel.load(path).transform(rows)
    return rounded(out.withColumn("scaled", F.get(vector_to_array("y"), 0)), ["scaled"])


@add("k08_backup_and_rewrite", f"{B} SELECT ticker, date, {R('close * 2')} AS close, {R('close')} AS before FROM bars")
def rewrite(spark, sf_dir):
    path = sinks.scratch(spark)
    sinks.parquet(bars(spark, sf_dir).select("ticker", "date", "close"), path)
    old = sinks.rewritten(spark, path, lambda df: df.withColumn("close", F.col("close") * 2))
    both = spark.read.parquet(path).join(spark.read.parquet(old).withColumnRenamed("close", "before"), list(KEYS))
    return rounded(both, ["close", "before"])


@add("s05_s20_f30_raw_folder", f"{B} SELECT ticker, date, {R('close')} AS close, {R('volume')} AS volume FROM bars")
def raw_folder(spark, sf_dir):
    """The first folder that there is: a file per instrument, whose name is its ticker, with other names for the columns, and one that is corrupt."""
    path = sinks.scratch(spark)
    raw = bars(spark, sf_dir).select("ticker", F.col("date").alias("Date"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    files.instrument_files(raw, path)
    where, root = files.opened(path)
    with where.open_output_stream(f"{root}/broken.parquet") as f:
        f.write(b"no parquet")
    if files.first_readable(spark, [f"{path}-none", f"{path}/1.parquet"]) is None or [p for p, _ in files.unreadable(spark, [f"{path}/1.parquet", f"{path}/broken.parquet"])] != [f"{path}/broken.parquet"]:
        raise ValueError("the folder isn't as it was written")
    return rounded(files.raw_prices(spark, path), ["close", "volume"])


@add("k03_upsert", f"{B} SELECT ticker, date, {R('CASE WHEN date >= DATE {0} AND ticker::INT % 2 = 0 THEN 2 * close ELSE close END'.format(chr(39) + '1998-01-01' + chr(39)))} AS close FROM bars")
def upsert(spark, sf_dir):
    """A history by date, of which some keys of the later dates come again."""
    path, b = sinks.scratch(spark), bars(spark, sf_dir).select("ticker", F.trunc("date", "year").alias("year"), "date", "close")
    keys = ("ticker", "date")
    sinks.upsert(spark, b, path, keys, "year")
    fresh = b.where("date >= '1998-01-01' and cast(ticker as int) % 2 = 0").withColumn("close", F.col("close") * 2)
    sinks.upsert(spark, fresh, path, keys, "year")
    return rounded(spark.read.parquet(path), ["close"])


@add("s12_bars_from_json", f"{B} SELECT ticker, date, {R('close')} AS close, {R('vwap')} AS vwap, {R('transactions')} AS transactions FROM bars WHERE ticker::INT % 7 <> 0")
def json_bars(spark, sf_dir):
    r = F.struct((F.unix_timestamp(F.col("date").cast("timestamp")) * 1000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"), F.col("transactions").alias("n"))
    status = F.when(F.col("ticker").cast("int") % 7 == 0, "NOT_FOUND").otherwise("OK")
    path = json_of(spark, bars(spark, sf_dir).select("ticker", F.array(r).alias("results"), status.alias("status")), sinks.scratch(spark))
    return rounded(files.bars_from_json(spark, path), ["close", "vwap", "transactions"])


@add("s13_overview_from_json", f"SELECT s_suppkey::VARCHAR AS ticker, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name, {R('CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END')} AS market_cap, coalesce(s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0, false) AS is_common_stock, CASE WHEN s_suppkey % 5 = 0 THEN 'not_found' ELSE 'ok' END AS reference_status FROM supplier")
def overview(spark, sf_dir):
    k = F.col("s_suppkey")
    there = F.struct(F.col("s_name").alias("name"), F.when(k % 3 == 0, "ETF").otherwise("cs").alias("type"), F.lit(True).alias("active"), F.col("s_acctbal").cast("double").alias("market_cap"))
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("ticker"), F.when(k % 5 != 0, there).alias("results"), F.when(k % 5 == 0, "NOT_FOUND").otherwise("OK").alias("status"))
    return rounded(files.overview_from_json(spark, json_of(spark, rows, sinks.scratch(spark))), ["market_cap"], ("ticker", "name", "is_common_stock", "reference_status"))


CONTRACTS = "SELECT l_suppkey::VARCHAR AS ticker, date_trunc('year', l_shipdate)::DATE AS day, 'O:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || round(l_extendedprice * 100)::BIGINT AS contract, l_extendedprice AS strike, l_quantity AS open_interest FROM lineitem"


@add("s14_chain_from_json", f"WITH c AS ({CONTRACTS}) SELECT ticker, day, contract, {R('strike')} AS strike, {R('open_interest')} AS open_interest FROM c QUALIFY row_number() OVER (PARTITION BY ticker, day ORDER BY contract) <= 2000")
def chain(spark, sf_dir):
    price = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    name = F.concat_ws("-", F.concat(F.lit("O:"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), price)
    day = F.to_date(F.date_trunc("year", "l_shipdate")).cast("string")
    details = F.struct(name.alias("ticker"), F.col("l_extendedprice").cast("double").alias("strike_price"), F.lit("CALL").alias("contract_type"), F.lit("2030-01-18").alias("expiration_date"))
    r = F.struct(details.alias("details"), F.struct(F.lit(0.5).alias("delta")).alias("greeks"), F.struct(F.lit(1.0).alias("volume")).alias("day"), F.col("l_quantity").cast("double").alias("open_interest"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("ticker"), day.alias("asof"), F.array(r).alias("results"))
    out = files.chain_from_json(spark, json_of(spark, rows, sinks.scratch(spark)))
    return rounded(out.withColumnRenamed("asof", "day"), ["strike", "open_interest"], ("ticker", "day", "contract"))


@add("s16_news_from_json", "SELECT conv_id::VARCHAR AS ticker, text AS title, turn::VARCHAR AS published FROM conversations WHERE text IS NOT NULL")
def news(spark, sf_dir):
    """Titles under one of three names, by turn."""
    k, none = F.col("turn") % 3, F.lit(None).cast("string")
    at = F.col("turn").cast("string")
    r = F.struct(*[F.when(k == n, F.col("text")).otherwise(none).alias(x) for n, x in enumerate(("title", "headline", "name"))], *[F.when(k == n, at).otherwise(none).alias(x) for n, x in enumerate(("published_utc", "published_at", "date"))])
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").cast("string").alias("ticker"), F.array(r).alias("results"))
    return files.news_from_json(spark, json_of(spark, rows, sinks.scratch(spark)))


@add("s15_statements_from_json", f"SELECT o_custkey::VARCHAR AS ticker, o_orderdate::DATE AS period_end, {R('o_totalprice')} AS revenue, {R('o_totalprice / 2')} AS net_income FROM orders")
def statements(spark, sf_dir):
    day = F.to_date("o_orderdate").cast("string")
    r = F.struct(day.alias("period_end"), day.alias("filing_date"), F.col("o_totalprice").cast("double").alias("revenue"), (F.col("o_totalprice").cast("double") / 2).alias("net_income"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), F.array(r).alias("results"))
    out = files.statements_from_json(spark, json_of(spark, rows, sinks.scratch(spark)), ("revenue", "net_income"))
    return rounded(out, ["revenue", "net_income"], ("ticker", "period_end"))


@add("s19_compensation_from_json", f"SELECT o_custkey::VARCHAR AS ticker, {R('sum(o_totalprice)')} AS total_pay, {R('avg(o_totalprice)')} AS mean_pay FROM orders GROUP BY o_custkey")
def compensation(spark, sf_dir):
    pay = F.col("o_totalprice").cast("double")
    r = F.struct(F.lit("Chief Executive Officer").alias("position"), pay.alias("total"), (pay / 2).alias("stock_awards"), F.lit(None).cast("double").alias("option_awards"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), F.array(r).alias("results"))
    out = fundamentals.compensation(files.compensation_from_json(spark, json_of(spark, rows, sinks.scratch(spark))))
    return rounded(out, ["total_pay", "mean_pay"], ("ticker",))


LAST_OF_DAY = "SELECT user_id, ts::DATE AS date, max(ts) AS ts, arg_max(event_id, row(ts, event_id)) AS event_id, round(arg_max(value, row(ts, event_id)), 6) AS value FROM events GROUP BY ALL"


@add("k03_k04_resumed_backfill", LAST_OF_DAY)
def resumed_backfill(spark, sf_dir):
    """The last event of each user and day, from files that arrive in two deliveries: the second run goes on where the first stopped."""
    inbox, root = sinks.scratch(spark), sinks.scratch(spark)
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), "ts", "event_id", "value")
    history = backfill.History(f"{root}/history", "user_id bigint, date date, ts timestamp, event_id bigint, value double", ("user_id", "date"), ("ts", "event_id"))
    odd = F.xxhash64("event_id") % 2 != 0
    for part in (odd, ~odd):
        events.where(part).repartition(2).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        backfill.backfill(stream, history, f"{root}/checkpoint")
    return history.read(spark).withColumn("value", F.round("value", 6))


PAGE = 40


@add("s12_s14_paged_chain", f"""WITH c AS (SELECT l_suppkey AS k, 'O:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || round(l_extendedprice * 100)::BIGINT AS contract, l_quantity AS open_interest FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY contract, open_interest) - 1 AS item FROM c)
SELECT k::VARCHAR AS ticker, (item // {PAGE})::INT AS page, item::INT AS item, contract, {R('open_interest')} AS open_interest, 'ok' AS fetch_status, (CASE WHEN k % 7 = 1 THEN 1 ELSE 0 END)::INT AS retries FROM n WHERE k % 7 <> 2
UNION ALL SELECT DISTINCT k::VARCHAR, 0, NULL, NULL, NULL, 'throttled', 2 FROM n WHERE k % 7 = 2""")
def paged_chain(spark, sf_dir):
    """Contracts of each instrument over pages that name the next one; some pages are throttled once, some always."""
    price = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    name = F.concat_ws("-", F.concat(F.lit("O:"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), price)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), name.alias("contract"), F.col("l_quantity").cast("double").alias("open_interest"))
    w = Window.partitionBy("k").orderBy("contract", "open_interest")
    rows = rows.withColumns({"item": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("k"))})
    pages = rows.groupBy("k", "n", F.floor(F.col("item") / PAGE).alias("page")).agg(F.sort_array(F.collect_list(F.struct("item", "contract", "open_interest"))).alias("results"))
    following = F.when((F.col("page") + 1) * PAGE < F.col("n"), F.concat(F.lit("https://host/v1/"), F.col("k").cast("string"), F.lit("@"), (F.col("page") + 1).cast("string"), F.lit(".json")))
    reply = F.to_json(F.struct(F.col("k").cast("string").alias("ticker"), F.lit("OK").alias("status"), "results", following.alias("next_url")))
    busy, first = F.lit('{"status": 429}'), F.col("page") == 0
    body = F.when(first & (F.col("k") % 7 == 1), F.concat(F.lit("["), busy, F.lit(", "), reply, F.lit("]"))).when(first & (F.col("k") % 7 == 2), busy).otherwise(reply)
    file = F.concat(F.col("k").cast("string"), F.when(~first, F.concat(F.lit("@"), F.col("page").cast("string"))).otherwise(""), F.lit(".json"))
    path = sinks.scratch(spark)
    paged.publish(pages.select(file.alias("name"), body.alias("body")), path)
    paged.register(spark)
    out = spark.read.format("paged_replies").option("path", path).option("wait", "0").load()
    r = F.from_json("result", "contract string, open_interest double")
    return rounded(out.withColumns({"contract": r["contract"], "open_interest": r["open_interest"]}), ["open_interest"], ("ticker", "page", "item", "contract", "fetch_status", "retries"))


QUERIES, ORACLES = Q, O
