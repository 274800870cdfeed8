"""Queries S, F, J, U, T and parts of A: ingest, quality, joins, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import columns as c
from quillon.operators import universe as u
from quillon.plans import sql as s
from quillon.plans.technicals import rounded
from quillon.sources.panels import bars, reference_master, table, ticks

Q, O = {}, {}


def add(name: str, oracle: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle is not None:
            O[name] = oracle
        return f

    return keep


B = f"WITH {s.BARS}"
R = s.rounded


@add("entry_latest_sector_rank", s.chain(s.BARS, {"_r": f"ln(close / {s.lag('close')})"}, {"z": s.z("_r", 20)}, {"sector_rank": s.rank("z", "date", "sector"), "_n": "row_number() OVER (PARTITION BY ticker ORDER BY date DESC)"}, start="sbars", keys="ticker, date, sector", out=["z", "sector_rank"], where="WHERE _n = 1"))
def entry(spark, sf_dir):
    df = bars(spark, sf_dir, True).withColumn("_r", F.ln(F.col("close") / c.lag("close")))
    df = df.withColumn("z", c.z("_r", 20)).withColumn("sector_rank", c.rank_share("z", "date", "sector"))
    return rounded(u.keep_last(df, ("ticker",), F.col("date")), ["z", "sector_rank"], ("ticker", "date", "sector"))


@add("s02_s03_projected_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'")
def projected(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    wanted = ("l_orderkey", "l_quantity", "not_there")
    return df.where("l_shipdate >= timestamp'2001-01-01'").select(*[x for x in wanted if x in df.columns])


@add("s01_a05_weekly_bars", f"{B} SELECT ticker, date, {', '.join(f'{R(x)} AS {x}' for x in ('open', 'high', 'low', 'close', 'volume', 'vwap', 'transactions'))} FROM bars")
def weekly(spark, sf_dir):
    return rounded(bars(spark, sf_dir), ["open", "high", "low", "close", "volume", "vwap", "transactions"])


@add("s06_s07_s08_s09_standardise", "SELECT upper(c_name) AS ticker, c_acctbal AS mkt_cap, nullif(trim(c_mktsegment), '') AS sector FROM customer")
def standardised(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").selectExpr("c_name AS Symbol", "c_acctbal AS `Market Cap`", "c_mktsegment AS GICS_Sector")
    return u.standardise(raw).select("ticker", "mkt_cap", "sector")


WIDE = "SELECT date, avg(CASE WHEN ticker = '1' THEN close END) AS dxy_close, avg(CASE WHEN ticker = '2' THEN close END) AS uso_close, avg(CASE WHEN ticker = '3' THEN close END) AS tnx_close FROM bars GROUP BY date"


@add("s10_u07_unpivot_series", f"{B}, w AS ({WIDE}) SELECT date, label, {R('close')} AS close FROM (SELECT date, 'dxy' AS label, dxy_close AS close FROM w UNION ALL SELECT date, 'uso', uso_close FROM w UNION ALL SELECT date, 'tnx', tnx_close FROM w) WHERE close IS NOT NULL")
def unpivoted(spark, sf_dir):
    b = bars(spark, sf_dir)
    wide = b.groupBy("date").agg(*[F.avg(F.when(F.col("ticker") == t, F.col("close"))).alias(f"{x}_close") for x, t in (("dxy", "1"), ("uso", "2"), ("tnx", "3"))])
    long = wide.unpivot("date", ["dxy_close", "uso_close", "tnx_close"], "name", "close").where("close is not null")
    return rounded(long.withColumn("label", F.regexp_replace("name", "_close$", "")), ["close"], ("date", "label"))


@add("s11_j17_pick_series", f"{B} SELECT date, {R('close')} AS close FROM bars WHERE ticker = '7'")
def picked(spark, sf_dir):
    return rounded(bars(spark, sf_dir).where("ticker = '7'"), ["close"], ("date",))


@add("s21_s22_spot_fallback", f"{B}, l AS (SELECT ticker, arg_max(close, date) AS last_close FROM bars GROUP BY ticker) SELECT s_suppkey AS id, {R('coalesce(l.last_close, CASE WHEN s_acctbal > 0 THEN s_acctbal END)')} AS spot, CASE WHEN l.last_close IS NOT NULL THEN 'cache' WHEN s_acctbal > 0 THEN 'chain' ELSE 'none' END AS source FROM supplier LEFT JOIN l ON l.ticker = s_suppkey::VARCHAR AND s_suppkey % 2 = 0")
def spot(spark, sf_dir):
    last = bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "date").alias("last_close"))
    sup = table(spark, sf_dir, "supplier")
    both = sup.join(last, (F.col("ticker") == F.col("s_suppkey").cast("string")) & (F.col("s_suppkey") % 2 == 0), "left")
    chain = c.positive("s_acctbal")
    out = both.select(F.col("s_suppkey").alias("id"), F.coalesce("last_close", chain).alias("spot"), F.when(F.col("last_close").isNotNull(), "cache").when(chain.isNotNull(), "chain").otherwise("none").alias("source"))
    return rounded(out, ["spot"], ("id", "source"))


@add("s23_business_days", "WITH o AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT min(d) AS a, max(d) AS b FROM o), c AS (SELECT unnest(range(a, b + 1, INTERVAL 1 DAY))::DATE AS date FROM e) SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS since_first, coalesce(n, 0) AS orders FROM c LEFT JOIN o ON o.d = c.date WHERE isodow(date) < 6")
def calendar(spark, sf_dir):
    """Week days from the first order's day to the last's, numbered, with the orders of each."""
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("orders"))
    ends = orders.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = ends.select("first", F.explode(F.sequence("first", "last")).alias("date")).where(F.weekday("date") < 5)
    # Week days since the first one, which need not be the first order's day.
    before = u.business_days(F.col("first"), F.col("date"))
    return days.join(orders, "date", "left").select("date", before.alias("since_first"), F.coalesce("orders", F.lit(0)).alias("orders"))


@add("s24_u03_clean_tickers", "SELECT DISTINCT upper(trim(p_brand)) AS ticker FROM part WHERE trim(p_brand) <> ''")
def tickers(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.upper(F.trim("p_brand")).alias("ticker")).where("ticker <> ''").distinct()


@add("u01_u02_k03_merge_last_wins", f"{B}, a AS (SELECT ticker, date, close, 0 AS p FROM bars WHERE date < DATE '2000-01-01' UNION ALL SELECT ticker, date, close + 1, 1 FROM bars WHERE date >= DATE '1999-01-01') SELECT ticker, date, {R('arg_max(close, p)')} AS close FROM a GROUP BY ticker, date")
def merged(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "date", "close")
    return rounded(u.merge_sources(b.where("date < '2000-01-01'"), b.where("date >= '1999-01-01'").withColumn("close", F.col("close") + 1)), ["close"])


@add("u10_replace_date", f"{B} SELECT ticker, date, {R('CASE WHEN date = (SELECT max(date) FROM bars) THEN close * 2 ELSE close END')} AS close FROM bars")
def replaced(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "date", "close")
    fresh = b.join(b.agg(F.max("date").alias("date")), "date", "left_semi").select("ticker", "date", (F.col("close") * 2).alias("close"))
    return rounded(u.upsert(b, fresh, ("ticker", "date"), True), ["close"])


@add("u04_duplicate_keys", "SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def duplicates(spark, sf_dir):
    w = Window.partitionBy("l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("n")).where("n > 1")


@add("u05_key_sets", "SELECT 'only_left' AS kind, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'both', c_custkey FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def key_sets(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k"), table(spark, sf_dir, "orders").selectExpr("o_custkey AS k")
    return a.subtract(b).select(F.lit("only_left").alias("kind"), "k").unionByName(a.intersect(b).select(F.lit("both").alias("kind"), "k"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@add("u06_pivot", f"SELECT c_nationkey, {', '.join(f'''{R(f'''avg(CASE WHEN c_mktsegment = '{x}' THEN c_acctbal END)''')} AS {x.lower()}''' for x in SEGMENTS)} FROM customer GROUP BY c_nationkey")
def pivoted(spark, sf_dir):
    wide = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", list(SEGMENTS)).agg(F.avg("c_acctbal"))
    return rounded(wide.select("c_nationkey", *[F.col(x).alias(x.lower()) for x in SEGMENTS]), [x.lower() for x in SEGMENTS], ("c_nationkey",))


FUT = s.frame(6).replace("5 PRECEDING AND CURRENT ROW", "5 FOLLOWING AND 10 FOLLOWING")


@add("u08_w32_future_maximum", f"{B} SELECT ticker, date, {R(f'max(close) OVER {FUT}')} AS peak FROM bars")
def future(spark, sf_dir):
    return rounded(bars(spark, sf_dir).withColumn("peak", F.max("close").over(c.series().rowsBetween(5, 10))), ["peak"])


@add("t01_t03_last_rows", f"{B} SELECT ticker, date, {R('close')} AS close, n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars) WHERE n <= 22")
def last_rows(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return rounded(bars(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 22"), ["close"], ("ticker", "date", "n"))


@add("t05_t07_top", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def top(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20)


@add("t06_j13_first_tickers", f"{B} SELECT ticker, date, {R('close')} AS close FROM bars WHERE ticker IN (SELECT DISTINCT ticker FROM bars ORDER BY 1 LIMIT 10)")
def first_tickers(spark, sf_dir):
    b = bars(spark, sf_dir)
    few = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(F.col("l_suppkey").cast("string").alias("ticker")).distinct().orderBy("ticker").limit(10)
    return rounded(b.join(few, "ticker", "left_semi"), ["close"])


@add("t08_hash_sample", "SELECT p_partkey, md5('42|' || p_partkey) AS h FROM part ORDER BY h, p_partkey LIMIT 250")
def sample(spark, sf_dir):
    """The first rows by a hash with a seed: a sample that any engine repeats."""
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(F.concat(F.lit("42|"), F.col("p_partkey").cast("string"))).alias("h")).orderBy("h", "p_partkey").limit(250)


@add("f02_f03_f04_clean_keys", "SELECT upper(trim(c_name)) AS ticker, try_cast(substr(c_name, 10) AS DOUBLE) AS number FROM customer WHERE trim(c_name) <> ''")
def cleaned(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.upper(F.trim("c_name")).alias("ticker"), F.substring("c_name", 10, 100).try_cast("double").alias("number"))
    return df.dropna(subset=["ticker"]).where("ticker <> ''")


@add("f05_f06_f07_bad_values", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS close, CASE WHEN s_acctbal > 0 THEN round(1000 / s_acctbal, 6) END AS inverse FROM supplier")
def bad_values(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("close"), F.lit(1.0).alias("volume"))
    return u.bad_close(df, "null").select("s_suppkey", "close", F.round(c.div(F.lit(1000.0), "close"), 6).alias("inverse"))


@add("f08_a04_j13_liquid", f"{B}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars) SELECT ticker, {R('arg_max(close, date)')} AS last_close, {R('avg(volume)')} AS avg_volume, count(*) AS n_rows FROM r WHERE n <= 22 GROUP BY ticker HAVING arg_max(close, date) >= 1000 AND avg(volume) >= 50 AND count(*) >= 22")
def liquid(spark, sf_dir):
    return rounded(u.liquid(bars(spark, sf_dir), 1000, 50), ["last_close", "avg_volume"], ("ticker", "n_rows"))


ELIGIBLE = f"{B}, m AS (SELECT ticker, date, avg(close) OVER {s.frame(22)} AS mc, avg(volume) OVER {s.frame(22)} AS mv, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars)"


@add("f09_f11_f12_j2_eligible", f"{ELIGIBLE} SELECT master.ticker, {R('mc')} AS mean_close, {R('mv')} AS mean_volume, coalesce(mc >= 1000 AND mv >= 50 AND market_cap >= 2000, false) AS eligible FROM master LEFT JOIN m ON m.ticker = master.ticker AND n = 1")
def eligible(spark, sf_dir):
    return rounded(u.eligible(bars(spark, sf_dir), reference_master(spark, sf_dir), 1000, 50, 2000), ["mean_close", "mean_volume"], ("ticker", "eligible"))


@add("f10_split_types", "SELECT CASE WHEN p_type LIKE '%BRASS' THEN 'CS' WHEN p_type LIKE '%STEEL' THEN 'ETF' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def split(spark, sf_dir):
    kind = F.when(F.col("p_type").endswith("BRASS"), "CS").when(F.col("p_type").endswith("STEEL"), "ETF").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@add("f16_bool", "SELECT o_orderkey, o_orderstatus IN ('Y', 'T', '1') OR coalesce(try_cast(o_orderpriority[1] AS DOUBLE) > 2, false) AS flag FROM orders")
def bools(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (u.as_bool("o_orderstatus") | (F.coalesce(F.substring("o_orderpriority", 1, 1).try_cast("double") > 2, F.lit(False)))).alias("flag"))


@add("f17_f18_completeness", s.chain(s.BARS, {"_a": f"close / {s.lag('close', 5)}", "_b": s.mean("close", 20), "_c": s.mean("close", 60), "_d": "close"}, {"share": "((_a IS NOT NULL)::INT + (_b IS NOT NULL)::INT + (_c IS NOT NULL)::INT + 1) / 4.0"}, {"complete": "(share = 1)::INT", "enough": "(share >= 0.75)::INT"}, out=["share", "complete", "enough"]))
def completeness(spark, sf_dir):
    df = bars(spark, sf_dir).withColumns({"_a": c.div("close", c.lag("close", 5)), "_b": c.mean("close", 20), "_c": c.mean("close", 60)})
    share = sum((F.col(x).isNotNull().cast("int") for x in ("_a", "_b", "_c")), F.lit(1)) / 4
    return rounded(df.withColumn("share", share).withColumns({"complete": (F.col("share") == 1).cast("int"), "enough": (F.col("share") >= 0.75).cast("int")}), ["share", "complete", "enough"])


@add("f19_f20_f21_windows", f"{B} SELECT CASE WHEN date <= DATE '2000-12-31' THEN 'train_or_earlier' ELSE 'post_train' END AS sample_period, count(*) AS n, datediff('day', min(date), max(date)) AS span FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30' GROUP BY 1")
def sample_periods(spark, sf_dir):
    df = bars(spark, sf_dir).where(F.col("date").between("1996-01-01", "2001-06-30")).withColumn("sample_period", F.when(F.col("date") <= "2000-12-31", "train_or_earlier").otherwise("post_train"))
    return df.groupBy("sample_period").agg(F.count("*").alias("n"), F.datediff(F.max("date"), F.min("date")).cast("long").alias("span"))


INTEGRITY = f"""{B}, future_ AS (SELECT ticker FROM bars WHERE date > DATE '2001-12-01'), missing_ AS (SELECT DISTINCT ticker FROM bars WHERE ticker NOT IN (SELECT ticker FROM master)), low_ AS (SELECT ticker FROM master WHERE market_cap <= 0), dup_ AS (SELECT ticker FROM bars GROUP BY ticker, date HAVING count(*) > 1),
nocap_ AS (SELECT ticker FROM master WHERE market_cap IS NULL), nosec_ AS (SELECT ticker FROM master WHERE sector IS NULL), noind_ AS (SELECT ticker FROM master WHERE industry IS NULL) """ + " UNION ALL ".join(f"SELECT '{k}' AS check, '{v}' AS severity, count(*) AS n, coalesce(list_slice(list_sort(list(DISTINCT ticker)), 1, 50), []) AS examples FROM {t}" for k, v, t in (("duplicate_keys", "fail", "dup_"), ("future_dates", "fail", "future_"), ("missing_in_reference", "warn", "missing_"), ("ok_without_cap", "fail", "nocap_"), ("cap_not_positive", "fail", "low_"), ("without_sector", "warn", "nosec_"), ("without_industry", "warn", "noind_")))


@add("f22_f25_j14_integrity", INTEGRITY.replace("SELECT '", "SELECT '"))
def integrity(spark, sf_dir):
    return u.integrity(bars(spark, sf_dir), reference_master(spark, sf_dir), "2001-12-01")


@add("f23_f29_group_sizes", f"{B} SELECT ticker, count(*) AS n, count(*) >= 20 AS enriched, count(*) FILTER (close <= 0) AS bad FROM bars GROUP BY ticker")
def group_sizes(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n"), (F.count("*") >= 20).alias("enriched"), F.count_if(F.col("close") <= 0).alias("bad"))


@add("f27_f32_sector_resolution", "WITH x AS (SELECT c_custkey, c_nationkey AS ticker, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS sector FROM customer), k AS (SELECT ticker, count(DISTINCT sector) AS n, max(sector) AS one FROM x GROUP BY ticker) SELECT c_custkey, n > 1 AS sector_conflict, coalesce(sector, CASE WHEN n = 1 THEN one END) AS sector_resolved FROM x JOIN k USING (ticker)")
def resolution(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("ticker"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("sector"))
    return u.resolve_sector(df).select("c_custkey", "sector_conflict", "sector_resolved")


@add("f28_a22_modal_sector", "WITH n AS (SELECT o_custkey AS ticker, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY ALL) SELECT ticker, arg_max(p, row(n, -ascii(p))) AS gics_sector FROM n GROUP BY ticker")
def modal(spark, sf_dir):
    return u.modal_sector(table(spark, sf_dir, "orders").selectExpr("o_custkey AS ticker", "o_orderdate AS date", "o_orderpriority AS sector"), "1998-01-01")


@add("f26_a17_audit", s.chain(s.BARS, {"r": f"close / {s.lag('close')} - 1"}, {"z": s.z("r", 20)}, {"p": s.rank("z", "date")}, out=[]).rsplit(" SELECT ticker, date", 1)[0] + f" SELECT count(z) AS n_valid, {R('avg(z)')} AS z_mean, {R('stddev_samp(z)')} AS z_std, {R('1 - count(z) / count(*)::DOUBLE')} AS z_nan_rate, {R('min(p)')} AS pct_min, {R('max(p)')} AS pct_max, 1 - count(z) / count(*)::DOUBLE <= 0.35 AS gate FROM l2")
def audit(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("r", c.change("close")).withColumn("z", c.z("r", 20)).withColumn("p", c.rank_share("z", "date"))
    gone = 1 - F.count("z") / F.count("*")
    out = df.agg(F.count("z").alias("n_valid"), F.avg("z").alias("z_mean"), F.stddev_samp("z").alias("z_std"), gone.alias("z_nan_rate"), F.min("p").alias("pct_min"), F.max("p").alias("pct_max"), (gone <= 0.35).alias("gate"))
    return rounded(out, ["z_mean", "z_std", "z_nan_rate", "pct_min", "pct_max"], ("n_valid", "gate"))


@add("a16_group_distribution", f"{B}, n AS (SELECT date, sector, count(*) AS n FROM sbars GROUP BY date, sector) SELECT count(*) AS n_groups, min(n) AS least, floor(quantile_cont(n, 0.1))::BIGINT AS p10, floor(quantile_cont(n, 0.5))::BIGINT AS p50, floor(quantile_cont(n, 0.9))::BIGINT AS p90, max(n) AS most, count(*) FILTER (n < 10) AS below FROM n")
def distribution(spark, sf_dir):
    n = bars(spark, sf_dir, True).groupBy("date", "sector").agg(F.count("*").alias("n"))
    q = lambda p: F.floor(F.percentile("n", p)).cast("long")
    return n.agg(F.count("*").alias("n_groups"), F.min("n").alias("least"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.max("n").alias("most"), F.count_if(F.col("n") < 10).alias("below"))


@add("j1_j3_j15_dimensions", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimensions(spark, sf_dir):
    cust, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    both = u.unique_join(cust.withColumn("n_nationkey", F.col("c_nationkey")), n, "n_nationkey").withColumn("r_regionkey", F.col("n_regionkey"))
    return u.unique_join(both, r, "r_regionkey").select("c_custkey", "n_name", "r_name")


@add("j9_full_outer_minutes", f"WITH {s.TICKS}, a AS (SELECT ticker, minute, count(*) AS views FROM ticks WHERE off_exchange_flag = 1 GROUP BY ALL), b AS (SELECT ticker, minute, count(*) AS trades FROM ticks WHERE off_exchange_flag = 0 GROUP BY ALL) SELECT ticker, minute, views, trades FROM a FULL JOIN b USING (ticker, minute)")
def outer(spark, sf_dir):
    t = ticks(spark, sf_dir)
    a, b = (t.where(F.col("off_exchange_flag") == k).groupBy("ticker", "minute").agg(F.count("*").alias(n)) for k, n in ((1, "views"), (0, "trades")))
    return a.join(b, ["ticker", "minute"], "outer")


@add("j10_u09_context_prefix", f"WITH {s.TICKS}, d AS (SELECT ticker, date, count(*) AS n FROM ticks GROUP BY ALL) SELECT d.ticker, d.date, d.n, x.n AS ctx_n FROM d LEFT JOIN d x ON x.ticker = d.ticker AND x.date = d.date - 1")
def context(spark, sf_dir):
    d = ticks(spark, sf_dir).groupBy("ticker", "date").agg(F.count("*").alias("n"))
    return d.join(d.select("ticker", F.date_add("date", 1).alias("date"), F.col("n").alias("ctx_n")), ["ticker", "date"], "left")


@add("j8_j7_align_calendar", f"{B} SELECT a.date, {R('a.close')} AS close, {R('b.close')} AS other FROM bars a LEFT JOIN bars b ON b.ticker = '2' AND b.date = a.date WHERE a.ticker = '1'")
def aligned(spark, sf_dir):
    b = bars(spark, sf_dir)
    other = b.where("ticker = '2'").select("date", F.col("close").alias("other"))
    return rounded(b.where("ticker = '1'").join(other, "date", "left"), ["close", "other"], ("date",))


@add("j12_inner_on_date", f"{B} SELECT a.date, {R('a.close')} AS close, {R('b.close')} AS other FROM bars a JOIN bars b ON b.ticker = '2' AND b.date = a.date WHERE a.ticker = '1'")
def inner(spark, sf_dir):
    b = bars(spark, sf_dir)
    return rounded(b.where("ticker = '1'").join(b.where("ticker = '2'").select("date", F.col("close").alias("other")), "date"), ["close", "other"], ("date",))


@add("j11_j18_j19_summary_joins", f"{B}, l AS (SELECT ticker, arg_max(close, date) AS close FROM bars GROUP BY ticker), m AS (SELECT avg(close) AS market FROM l) SELECT master.ticker, sector, {R('l.close')} AS close, {R('market')} AS market FROM master LEFT JOIN l USING (ticker) CROSS JOIN m")
def summary_joins(spark, sf_dir):
    last = bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    # One row of market context, from an aggregate without keys.
    both = reference_master(spark, sf_dir).join(last, "ticker", "left").crossJoin(F.broadcast(last.agg(F.avg("close").alias("market"))))
    return rounded(both, ["close", "market"], ("ticker", "sector"))


@add("k04_resume_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o_orderkey"), "o_orderkey", "left_anti")


@add("a21_first_known", "SELECT o_custkey, arg_min(o_orderpriority, row(o_orderdate, o_orderkey)) AS first_priority FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")
def first_known(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 1000").groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"))


CODE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'x BETWEEN {a} AND {b}' for a, b in r)} THEN '{k}'" for k, r in u.CODE_SECTORS.items()) + " ELSE 'Unknown' END"


@add("x_code_sector", f"SELECT p_partkey, {CODE_SQL} AS sector FROM (SELECT p_partkey, (p_partkey * 7) % 9000 AS x FROM part)")
def code_sector(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", u.code_sector(((F.col("p_partkey") * 7) % 9000).cast("string")).alias("sector"))


@add("x_business_day_count", "SELECT o_orderkey, (SELECT count(*) FROM (SELECT unnest(range(o_orderdate::DATE, (o_orderdate::DATE + 30), INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6) AS days FROM orders WHERE o_orderkey % 10 >= 0")
def day_count(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", u.business_days(d, F.date_add(d, 30)).cast("long").alias("days"))


QUERIES, ORACLES = Q, O
