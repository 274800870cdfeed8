"""Queries over single row-window operators, gates and joins that no feature family needs alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import columns as c
from quillon.operators import assemble, cross, ewm, series, shape, text
from quillon.operators import universe as u
from quillon.plans import sql as s
from quillon.plans.technicals import rounded
from quillon.sources.panels import bars, reference_master, table

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
RET = {"_r": f"ln(close / {s.lag('close')})"}


def returns(spark, sf_dir, sectors: bool = False):
    return bars(spark, sf_dir, sectors).withColumn("_r", F.ln(F.col("close") / c.lag("close")))


SHIFTS = {"lag_1": s.lag("close"), "lead_4": s.lag("close", -4), "diff_2": f"close - {s.lag('close', 2)}", "change_5": f"{s.div('close', s.lag('close', 5))} - 1"}


@add("w01_w02_w03_w04_shifts", s.chain(s.BARS, SHIFTS))
def shifts(spark, sf_dir):
    df = bars(spark, sf_dir)
    df = df.withColumns({"lag_1": c.lag("close"), "lead_4": c.lag("close", -4), "diff_2": c.diff("close", 2), "change_5": c.change("close", 5)})
    return rounded(df, list(SHIFTS))


ROLLING = {"mean_20": s.mean("close", 20, 10), "std_20": s.std("close", 20, 10), "sum_20": s.total("close", 20, 10), "min_20": s.low("close", 20, 10), "max_20": s.high("close", 20, 10), "z_20": s.z("close", 20, 10), "z_floored": s.z("close", 20, 10, 1e-9)}


@add("w05_w07_rolling", s.chain(s.BARS, ROLLING))
def rolling(spark, sf_dir):
    df = bars(spark, sf_dir)
    each = {f"{n}_20": f("close", 20, 10) for n, f in (("mean", c.mean), ("std", c.std), ("sum", c.total), ("min", c.low), ("max", c.high), ("z", c.z))}
    return rounded(df.withColumns(each | {"z_floored": c.z("close", 20, 10, 1e-9)}), list(ROLLING))


W11 = {"z_sector": s.group_z("_r", "date", "sector", least=5), "z_date": s.zero(s.clip(s.group_z("_r", "date"), -10, 10))}


@add("w11_cross_section_z", s.chain(s.BARS, RET, W11, start="sbars"))
def cross_section(spark, sf_dir):
    df = returns(spark, sf_dir, True)
    return rounded(df.withColumns({"z_sector": c.group_z("_r", "date", "sector", least=5), "z_date": c.zero(c.clip(c.group_z("_r", "date"), -10, 10))}), list(W11))


@add("w15_ewm", s.chain(s.BARS, {"ewm_10": s.ewm("close", 2 / 11, 5), "ewm_wilder_14": s.ewm("close", 1 / 14, 14)}))
def smoothed(spark, sf_dir):
    df = ewm.ewm(bars(spark, sf_dir).select("ticker", "date", "close"), {"ewm_10": ("close", 2 / 11, 5), "ewm_wilder_14": ("close", 1 / 14, 14)})
    return rounded(df, ["ewm_10", "ewm_wilder_14"])


@add("w16_w17_w18_running_and_slope", s.chain(s.BARS, {"_i": f"row_number() OVER ({s.PO})"}, {"running_volume": f"sum(volume) OVER {s.ALL}", "slope_20": s.slope("close", 20), "r2_20": s.r2("close", 20)}, out=["running_volume", "slope_20", "r2_20"], digits=4))
def slopes(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("_i", c.numbered())
    df = df.withColumns({"running_volume": c.running("volume"), "slope_20": c.slope("close", 20), "r2_20": c.r_squared("close", 20)})
    return rounded(df, ["running_volume", "slope_20", "r2_20"], digits=4)


GK = "0.5 * ln(high / low) ^ 2 - (2 * ln(2) - 1) * ln(close / open) ^ 2"


@add("fu01_reversion_sources", f"{B} SELECT ticker, date, {R('ln(close)')} AS ou_source_log_close, {R(f'ln(1 + greatest({GK}, 0))')} AS ou_source_garman_klass_var_1d_log1p FROM bars")
def reversion_sources(spark, sf_dir):
    gk = 0.5 * F.pow(F.ln(F.col("high") / F.col("low")), 2) - (2 * F.ln(F.lit(2.0)) - 1) * F.pow(F.ln(F.col("close") / F.col("open")), 2)
    df = bars(spark, sf_dir).withColumns({"log_close": F.ln("close"), "garman_klass_var_1d": gk})
    made = [(f"ou_source_{label}", x) for label, x in map(series.ou_source, ("log_close", "garman_klass_var_1d"))]
    return rounded(df.withColumns(dict(made)), [n for n, _ in made])


@add("fp08_safe_arithmetic", f"{B} SELECT ticker, date, {R('CASE WHEN volume - 40 > 0 THEN ln(volume - 40) END')} AS safe_log, {R('CASE WHEN abs(volume - 40) > 0 THEN close / (volume - 40) END')} AS safe_ratio, {R('least(greatest(volume - 40, -5), 5)')} AS bounded FROM bars")
def safe_arithmetic(spark, sf_dir):
    x = F.col("volume") - 40
    return rounded(bars(spark, sf_dir).withColumns({"safe_log": c.log(x), "safe_ratio": c.div("close", x), "bounded": c.clip(x, -5, 5)}), ["safe_log", "safe_ratio", "bounded"])


@add("fe14_sector_ranks", s.chain(s.BARS, RET, {"_r_sector_rank": s.rank("_r", "date", "sector"), "volume_sector_rank": s.rank("volume", "date", "sector")}, start="sbars", out=["_r_sector_rank", "volume_sector_rank"]))
def sector_ranks(spark, sf_dir):
    return rounded(shape.sector_ranks(returns(spark, sf_dir, True), ("_r", "volume")), ["_r_sector_rank", "volume_sector_rank"])


@add("f15_history_gate", f"{B}, h AS (SELECT ticker, date, close, count(close) OVER {s.ALL} AS history_days FROM bars) SELECT ticker, date, history_days, history_days >= 60 AND close IS NOT NULL AS in_universe FROM h")
def history_gate(spark, sf_dir):
    return cross.institutional(bars(spark, sf_dir)).select("ticker", "date", "history_days", "in_universe")


@add("f01_required_columns", f"WITH {s.BARS}, n AS (SELECT *, {s.lag('close')} AS previous FROM bars), r AS (SELECT count(*) AS all_rows, count(*) - count(ticker) AS t, count(*) - count(date) AS d, count(*) - count(close) AS c, count(*) - count(previous) AS p FROM n) SELECT unnest(['ticker', 'date', 'close', 'previous', 'not_there']) AS required, unnest([true, true, true, true, false]) AS present, unnest([t, d, c, p, all_rows]) AS missing_rows FROM r")
def required(spark, sf_dir):
    """For each required column whether the panel has it, and how many rows miss its value; a column that isn't there is missing in all."""
    return u.required_columns(bars(spark, sf_dir).withColumn("previous", c.lag("close")), ("ticker", "date", "close", "previous", "not_there"))


@add("j6_assembled_panel", f"{B}, t AS (SELECT ticker, date, {s.mean('close', 20)} AS sma, close FROM bars), v AS (SELECT ticker, date, volume, {s.std('volume', 20)} AS sma FROM bars WHERE date >= DATE '1995-01-01') SELECT b.ticker, b.date, {R('b.close')} AS close, {R('t.sma')} AS sma, {R('v.sma')} AS volumes_sma, m.sector FROM bars b LEFT JOIN t USING (ticker, date) LEFT JOIN v USING (ticker, date) LEFT JOIN master m ON m.ticker = b.ticker")
def assembled(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "date", "close", "volume")
    averages = b.select("ticker", "date", c.mean("close", 20).alias("sma"))
    volumes = b.where("date >= '1995-01-01'").select("ticker", "date", c.std("volume", 20).alias("sma"))
    out = assemble.assemble(b.select("ticker", "date", "close"), {"averages": averages, "volumes": volumes})
    out = assemble.with_sector(out, reference_master(spark, sf_dir))
    return rounded(out, ["close", "sma", "volumes_sma"], ("ticker", "date", "sector"))


DAILY = "daily AS (SELECT user_id::VARCHAR AS ticker, ts::DATE AS date, avg(value) AS sent_score, count(*)::DOUBLE AS article_count_unique FROM events GROUP BY ALL)"
TRENDS = {f"sent_momentum_{n}d": s.mean("sent_score", n, k) for n, k in ((5, 3), (10, 5), (20, 10))} | {"sent_reversal_5d": f"sent_score - {s.lag('sent_score', 5)}", "sent_vol_20d": s.std("sent_score", 20, 10), "sent_trend_slope_10d": s.slope("sent_score", 10), "news_volume_z_20d": s.z("article_count_unique", 20, 10)}


@add("fi_a26_w17_sentiment_trends", s.chain(DAILY, {"_i": f"row_number() OVER ({s.PO})"}, TRENDS, start="daily"))
def sentiment_trends(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date"))
    daily = daily.agg(F.avg("value").alias("sent_score"), F.count("*").cast("double").alias("article_count_unique"))
    return rounded(text.sentiment_trends(daily), list(TRENDS))


CHANGES = {"close_delta": f"close - {s.lag('close')}", "volume_delta": f"volume - {s.lag('volume')}", "volume_growth": s.clip(f"({s.div('volume', s.lag('volume'))} - 1)", -5, 5)}


@add("w31_snapshot_changes", s.chain(s.BARS, CHANGES))
def snapshot_changes(spark, sf_dir):
    return rounded(text.snapshot_changes(bars(spark, sf_dir), ("close", "volume"), ("volume",)), list(CHANGES))


@add("s17_batch_prompts", "WITH n AS (SELECT x, (row_number() OVER (ORDER BY x) - 1) // 10 AS batch FROM (SELECT DISTINCT s_suppkey::VARCHAR AS x FROM supplier)) SELECT batch::BIGINT AS batch, 'Score the mood around: ' || string_agg(x, ', ' ORDER BY x) AS prompt FROM n GROUP BY batch")
def batch_prompts(spark, sf_dir):
    return text.batch_prompts(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker")), "Score the mood around: ")


@add("x09_scorer_blend", f"SELECT event_id, {R('CASE WHEN event_id % 3 = 0 THEN sin(value) ELSE least(greatest(0.75 * cos(value) + 0.25 * sin(value), -1), 1) END')} AS score FROM events")
def scorer_blend(spark, sf_dir):
    """An outside scorer's values (here a formula, with gaps) beside the heuristic's."""
    model = F.when(F.col("event_id") % 3 != 0, F.cos("value"))
    return rounded(table(spark, sf_dir, "events").withColumn("score", text.blended(model, F.sin("value"), 0.75)), ["score"], ("event_id",))


@add("x_money_and_file_names", r"SELECT c_custkey, CASE WHEN c_acctbal <= -1 THEN '-$' ELSE '$' END || format('{:,}', floor(abs(c_acctbal))::BIGINT) AS balance, left(regexp_replace(regexp_replace(c_name || ' / ' || c_mktsegment || '?', '[^A-Za-z0-9._-]+', '_', 'g'), '^[_.]+|_+$', '', 'g'), 120) AS file FROM customer")
def labels(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", c.money("c_acctbal").alias("balance"), c.file_name(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("?"))).alias("file"))


QUERIES, ORACLES = Q, O
