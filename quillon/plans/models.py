"""Queries M and A28: targets, folds, metrics, ensembles, fitted models; and the streaming forms."""

from __future__ import annotations

import atexit
import hashlib

from pyspark.sql import functions as F

from quillon.config import CrossValidation
from quillon.functions import columns as c
from quillon.operators import cross, markov, models, series, training
from quillon.operators.quantiles import exact_quantiles
from quillon.plans import sql as s
from quillon.plans.technicals import CHG, rounded
from quillon.sources import sinks
from quillon.sources.panels import bars, dealt, table
from quillon.streaming import ticks as streaming

Q, O = {}, {}
R = s.rounded


def add(name: str, oracle: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle is not None:
            O[name] = oracle
        return f

    return keep


FWD = f"ln({s.lag('close', -4)} / close)"


@add("m04_targets", f"WITH {s.BARS}, f AS (SELECT ticker, date, {FWD} AS r FROM bars) SELECT ticker, date, (r > 0)::INT AS target_up_4d, (exp(r) - 1 >= 0.05)::INT AS target_gain_5, (exp(r) - 1 <= -0.05)::INT AS target_loss_5, (exp(r) - 1 >= 0.08)::INT AS target_gain_8, (exp(r) - 1 <= -0.08)::INT AS target_loss_8 FROM f")
def targets(spark, sf_dir):
    return models.targets(bars(spark, sf_dir), 4).select("ticker", "date", "target_up_4d", *[f"target_{k}_{t}" for t in (5, 8) for k in ("gain", "loss")])


DATES = "d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS d FROM (SELECT DISTINCT date_trunc('week', l_shipdate)::DATE AS date FROM lineitem WHERE l_quantity > 0))"


@add("m05_j17_purged_folds", f"WITH {DATES}, f AS (SELECT *, k AS fold, d // 6 AS size FROM d, (SELECT unnest(range(1, 6)) AS k) WHERE d >= 6 * 30) SELECT fold::INT AS fold, date, CASE WHEN i < fold * size - 20 THEN 'train' ELSE 'test' END AS part FROM f WHERE i < fold * size - 20 OR (i >= fold * size AND (fold = 5 OR i < (fold + 1) * size))")
def folds(spark, sf_dir):
    return models.purged_folds(bars(spark, sf_dir).select("date"), 5, 20)


@add("m06_walk_forward", f"WITH {DATES}, f AS (SELECT *, k AS fold, 200 + (k - 1) * 30 AS st FROM d, (SELECT unnest(range(1, 40)) AS k) WHERE k <= (d - 200) // 30), g AS (SELECT *, st - 25 AS cut, floor((st - 25) * 0.8) AS stp FROM f WHERE st - 25 >= 100) SELECT fold::INT AS fold, date, CASE WHEN i < stp THEN 'train' WHEN i < cut THEN 'early_stop' ELSE 'validation' END AS part FROM g WHERE i < cut OR i BETWEEN st AND st + 29")
def walk(spark, sf_dir):
    return models.walk_forward(bars(spark, sf_dir).select("date"), 20, 200, 30)


DAYS = DATES.replace("date_trunc('week', l_shipdate)", "l_shipdate")


@add("m06_daily_walk_forward", f"WITH {DAYS}, f AS (SELECT *, k AS fold, 504 + (k - 1) * 63 AS st FROM d, (SELECT unnest(range(1, 100)) AS k) WHERE k <= (d - 504) // 63), g AS (SELECT *, st - 25 AS cut, floor((st - 25) * 0.8) AS stp FROM f) SELECT fold::INT AS fold, date, CASE WHEN i < stp THEN 'train' WHEN i < cut THEN 'early_stop' ELSE 'validation' END AS part FROM g WHERE i < cut OR i BETWEEN st AND st + 62")
def daily_walk(spark, sf_dir):
    """Daily dates with the usual sizes: two years before the first block, blocks of a quarter."""
    days = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(F.to_date("l_shipdate").alias("date"))
    return models.walk_forward(days, 20)


SCORES = "p AS (SELECT o_custkey % 5 AS fold, (o_totalprice > 30000)::INT AS label, round((o_orderkey * 37 % 1000) / 1000.0, 3) AS p FROM orders)"


@add("m11_a28_metrics", f"WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rk, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM p) SELECT fold, count(*) AS n_rows, {R('(sum(label * rk) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))')} AS auc, {R('-avg(label * ln(q) + (1 - label) * ln(1 - q))')} AS log_loss, {R('avg((p - label) ** 2)')} AS brier FROM r GROUP BY fold")
def metrics(spark, sf_dir):
    return rounded(models.metrics(predictions(spark, sf_dir), ("fold",)), ["auc", "log_loss", "brier"], ("fold", "n_rows"))


def predictions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 5).alias("fold"), (F.col("o_totalprice") > 30000).cast("int").alias("label"), F.round((F.col("o_orderkey") * 37 % 1000) / 1000, 3).alias("p"))


@add("a28_across_folds", f"WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rk, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM p), m AS (SELECT fold, (sum(label * rk) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc, -avg(label * ln(q) + (1 - label) * ln(1 - q)) AS log_loss, avg((p - label) ** 2) AS brier FROM r GROUP BY fold) SELECT " + ", ".join(f"{R(f'{f}({x})')} AS {x}_{n}" for x in ("auc", "log_loss", "brier") for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"))) + " FROM m")
def across(spark, sf_dir):
    out = models.across_folds(models.metrics(predictions(spark, sf_dir), ("fold",)))
    return rounded(out, out.columns, ())


@add("m08_ensemble", f"WITH e AS (SELECT s_suppkey, (s_suppkey % 10) / 10.0::DOUBLE AS a, (s_suppkey % 7) / 7.0::DOUBLE AS b, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 0.5::DOUBLE END AS c FROM supplier), m AS (SELECT *, list_filter([a, b, c], lambda x: x IS NOT NULL) AS l FROM e) SELECT s_suppkey, {R('list_avg(l)')} AS ensemble_p, {R('least(greatest(1 - list_stddev_pop(l) / 0.25, 0), 1) * 0.7 + len(l) / 3.0 * 0.3')} AS confidence FROM m")
def ensemble(spark, sf_dir):
    k = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 10 / 10).alias("a"), (k % 7 / 7).alias("b"), F.when(k % 3 != 0, 0.5).alias("c"))
    return rounded(models.ensemble(df, ["a", "b", "c"], models.complete_share(["a", "b", "c"])), ["ensemble_p", "confidence"], ("s_suppkey",))


@add("m10_imputation", "WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer) SELECT c_custkey, coalesce(v, (SELECT quantile_disc(v, 0.5) FROM x)) AS v_filled FROM x")
def imputed(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return models.filled(df, models.medians(df, ["v"])).select("c_custkey", "v_filled")


FEATURES = ("ret_1", "vol_20", "dd_60")


def feature_panel(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("ret_1", c.change("close"))
    return df.withColumns({"vol_20": c.std("ret_1", 20), "dd_60": c.div("close", c.high("close", 60)) - 1})


@add("a15_clip_bounds", f"WITH {s.BARS}, r AS (SELECT {CHG('close')} AS x FROM bars) SELECT {R('quantile_cont(x, 0.01)')} AS low, {R('quantile_cont(x, 0.99)')} AS high FROM r")
def bounds(spark, sf_dir):
    rows = sinks.stored(feature_panel(spark, sf_dir).select("ret_1"))
    low, high = exact_quantiles(rows, {"ret_1": [0.01, 0.99]})["ret_1"]
    return rounded(spark.createDataFrame([(low, high)], "low double, high double"), ["low", "high"], ())


def fitted_mixture(spark, sf_dir):
    df = sinks.stored(feature_panel(spark, sf_dir).select("ticker", "date", *FEATURES))
    return df, models.RegimeModel(FEATURES).fit(df.where(F.col("date") <= "2000-12-31"))


@add("m01_mixture_regimes")
def mixture(spark, sf_dir):
    """Label, confidence, log-likelihood and the probability of each component."""
    df, model = fitted_mixture(spark, sf_dir)
    return model.transform(df).drop(*FEATURES)


@add("m01_mixture_grid")
def mixture_grid(spark, sf_dir):
    """BIC, AIC and likelihood of each number of components."""
    return fitted_mixture(spark, sf_dir)[1].scores(spark)


@add("m03_fx09_expanding_regimes")
def expanding(spark, sf_dir):
    m = series.macro_overlay(bars(spark, sf_dir), "1", {"tlt": "2", "hyg": "3", "lqd": "4", "vixy": "5"})
    return markov.expanding_regimes(m, ("macro_spy_vol_20d", "macro_spy_mom_20d"))


def labelled_panel(spark, sf_dir):
    df = models.targets(feature_panel(spark, sf_dir), 4).where("target_up_4d is not null").withColumn("label", F.col("target_up_4d").cast("double"))
    return sinks.stored(df.dropna(subset=list(FEATURES)).select("ticker", "date", "label", *FEATURES))


@add("m07_m09_f24_classifier")
def classifier(spark, sf_dir):
    """Out-of-time probabilities, with isotonic and logistic calibration on purged out-of-fold predictions of the training part."""
    df = labelled_panel(spark, sf_dir)
    train, test = df.where(F.col("date") < "2000-01-01"), df.where(F.col("date") >= "2000-02-15")
    estimator = models.classifier(list(FEATURES), "label")
    held = sinks.stored(models.out_of_fold(train, models.purged_folds(train.select("date"), 3, 4), estimator).select("label", "p"))
    scored = sinks.stored(models.probability(estimator.fit(train).transform(test)).select("ticker", "date", "label", "p"))
    both = models.calibrated(held, models.calibrated(held, scored), logistic=True, out="logistic_p")
    return both.select("ticker", "date", "label", "p", "calibrated_p", "logistic_p")


@add("m07_importance")
def importances(spark, sf_dir):
    """Each feature's share in the fitted trees, the largest first."""
    fitted = models.classifier(list(FEATURES), "label").fit(labelled_panel(spark, sf_dir).where(F.col("date") < "2000-01-01"))
    return spark.createDataFrame(models.importance(fitted, list(FEATURES)), "feature string, importance double")


#: Sized for weekly bars: four years before the first block, blocks of half a year.
WEEKLY = CrossValidation(least_train=208, block=26, least_rows=500)
TARGETS = [training.Target("target_up_4d", 4), training.Target("target_gain_5", 4)]


def normalised_panel(spark, sf_dir):
    """Targets, and z-scores and ranks within sector and date of returns over volatility.

    What goes by instrument comes first, on the exchange of the bars; then one exchange by date and sector.
    """
    returns = ("ret_5d_voladj", "ret_21d_voladj", "ret_63d_voladj")
    df = models.targets(cross.institutional(bars(spark, sf_dir, sectors=True)), 4)
    df = df.select("ticker", "date", "sector", "in_universe", *returns, *[t.column for t in TARGETS])
    return cross.sector_scores(dealt(df, "date", "sector", like=table(spark, sf_dir, "lineitem")), returns)


def trained_job(spark, sf_dir):
    """The job of this session over these tables: the queries below share its fits, as a job that is started again does."""
    of = hashlib.md5(f"{spark.sparkContext.applicationId}|{sf_dir}".encode()).hexdigest()
    root = f"{sinks.shared_folder(spark)}/quillon-training-{of}"
    atexit.register(sinks.discard, spark, root)
    return training.train(normalised_panel(spark, sf_dir), TARGETS, root, cv=WEEKLY)


@add("m06_m07_fold_metrics")
def fold_metrics(spark, sf_dir):
    """Walk-forward fits of each target: rows, rates, trees kept by early stopping, AUC, log loss, Brier score."""
    return training.fold_metrics(trained_job(spark, sf_dir))


@add("k07_training_report")
def training_report(spark, sf_dir):
    return training.report(trained_job(spark, sf_dir))


@add("k07_m07_mean_importance")
def mean_importance(spark, sf_dir):
    return training.mean_importance(trained_job(spark, sf_dir))


@add("k07_prediction_bands")
def prediction_bands(spark, sf_dir):
    return training.deciles(trained_job(spark, sf_dir))


@add("k07_m08_fold_ensemble")
def fold_ensemble(spark, sf_dir):
    """The mean of the kept fold models over the whole panel, with its confidence."""
    job = trained_job(spark, sf_dir)
    if not job.folds("target_up_4d"):  # tables too small for a fold
        return spark.createDataFrame([], "ticker string, date date, ensemble_p double, confidence double")
    return training.scored(job, job.rows.select("ticker", "date", *job.features), "target_up_4d").select("ticker", "date", "ensemble_p", "confidence")


def drained(stream):
    """What a stream gives over the files there are, written by its tasks to the shared folder."""
    spark, root = stream.sparkSession, sinks.scratch(stream.sparkSession)
    streaming.collect_once(stream, f"{root}/checkpoint", f"{root}/rows")
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


@add("stream_minute_bars", "SELECT user_id, date_trunc('minute', ts) AS minute, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL HAVING date_trunc('minute', min(ts)) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_bars(spark, sf_dir):
    out = drained(streaming.minute_bars(streaming.event_stream(spark, f"{sf_dir}/events.parquet*")))
    return out.withColumn("total", F.round("total", 6))


@add("stream_running_mean", "WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT event_id, user_id, k, value AS y FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.user_id, e.k, 0.8 * r.y + 0.2 * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT event_id, user_id, " + R("y") + " AS ewm FROM r")
def stream_mean(spark, sf_dir):
    out = drained(streaming.running_mean(streaming.event_stream(spark, f"{sf_dir}/events.parquet*"), 0.2))
    return rounded(out, ["ewm"], ("event_id", "user_id"))


@add("stream_sessions", "WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_sessions(spark, sf_dir):
    out = drained(streaming.sessions(streaming.event_stream(spark, f"{sf_dir}/events.parquet*")))
    return out.withColumn("total", F.round("total", 6))


@add("stream_streaks", "WITH e AS (SELECT *, lag(value) OVER w AS p, ts - lag(ts) OVER w > INTERVAL 12 HOUR AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT *, p IS NOT NULL AND NOT pause AND value > p AS rises, p IS NOT NULL AND NOT pause AND value < p AS falls FROM e), g AS (SELECT *, sum((NOT rises)::INT) OVER w AS a, sum((NOT falls)::INT) OVER w AS b FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, ts, (sum(rises::INT) OVER (PARTITION BY user_id, a ORDER BY ts, event_id))::INT AS up, (sum(falls::INT) OVER (PARTITION BY user_id, b ORDER BY ts, event_id))::INT AS down FROM g")
def stream_streaks(spark, sf_dir):
    """Rises and falls in a row of each user, counted by a stateful stream with timers."""
    return drained(streaming.streaks(streaming.event_stream(spark, f"{sf_dir}/events.parquet*")))


QUERIES, ORACLES = Q, O
