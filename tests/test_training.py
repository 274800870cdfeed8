"""The training job: early stopping, class weights, kept models, resumption, and its metrics against SQL over the stored predictions."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import functions as F

from quillon.config import Boosting, CrossValidation
from quillon.operators import cross, models, training
from quillon.plans import models as plans
from quillon.sources import panels, sinks

CV = CrossValidation(least_train=60, block=30, least_rows=100, least_features=0.5)
BOOST = Boosting(trees=25, rate=0.3, depth=3)


@pytest.fixture(scope="module")
def panel(spark):
    """150 dates of 15 instruments: a signal that a few trees find, then noise to overfit; a target of one class; missing values."""
    rng = random.Random(1)
    rows = []
    for d in range(150):
        for k in range(15):
            a = rng.gauss(0, 1)
            rows.append((f"t{k}", dt.date(2020, 1, 1) + dt.timedelta(d), a if rng.random() < 0.95 else None, rng.random(), float(k), int(rng.random() < (0.7 if a > 0 else 0.2)), 0))
    return spark.createDataFrame(rows, "ticker string, date date, a_zscore double, b_pctrank double, fwd_x_zscore double, up_3d int, never int").cache()


@pytest.fixture(scope="module")
def job(spark, panel, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('job')}"
    return training.train(panel, [training.Target("up_3d", 3), training.Target("never", 3)], root, b=BOOST, cv=CV, parallel=2)


def test_fits(job):
    fits = {(r.target, r.fold): r for r in job.fits.collect()}
    assert job.features == ("a_zscore", "b_pctrank")  # forward columns are none
    assert {r.status for r in fits.values() if r.target == "never"} == {"one class"}
    own = [r for r in fits.values() if r.target == "up_3d"]
    assert len(own) == 3 and all(r.status == "fitted" for r in own)
    for r in own:
        assert r.trees < r.most_trees == 25  # the rest would fit noise
        assert r.stop_rows > 0 and r.validation_rows == 30 * 15
        assert (r.validation_start - r.train_end).days > 3 + 5


def test_metrics_equal_sql_over_the_stored_predictions(job):
    got = {(r.target, r.fold): r for r in training.fold_metrics(job).where("status = 'fitted'").collect()}
    path = f"{job.root.removeprefix('file://')}/predictions/*/*/*.parquet"
    sql = f"""WITH p AS (SELECT * FROM read_parquet('{path}', hive_partitioning = true)),
    r AS (SELECT *, rank() OVER (PARTITION BY target, fold ORDER BY p) + (count(*) OVER (PARTITION BY target, fold, p) - 1) / 2.0 AS rk, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM p)
    SELECT target, fold, count(*) AS n, (sum(label * rk) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc,
      -avg(label * ln(q) + (1 - label) * ln(1 - q)) AS log_loss, avg((p - label) ** 2) AS brier FROM r GROUP BY ALL"""
    rows = duckdb.sql(sql).fetchall()
    assert len(rows) == len(got) == 3
    for target, fold, n, auc, log_loss, brier in rows:
        r = got[target, int(fold)]
        assert (r.validation_rows, r.auc, r.log_loss, r.brier) == (n, pytest.approx(auc), pytest.approx(log_loss), pytest.approx(brier))
        assert r.auc > 0.65
    (report,) = training.report(job).collect()
    assert report.folds == 3 and report.auc_mean == pytest.approx(sum(r[3] for r in rows) / 3)


def test_weights_balance_the_classes(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(0.0,)] * 90, "label double")
    w = df.withColumn("w", training.class_weight(F.col("label"), 100, 10)).groupBy("label").agg(F.sum("w").alias("w")).collect()
    assert [r.w for r in w] == [pytest.approx(50)] * 2


def test_fold_models_are_averaged(spark, panel, job):
    rows = panel.select("ticker", "date", *job.features).limit(200)
    out = training.scored(job, rows, "up_3d").collect()
    assert len(out) == 200
    for r in out:
        ps = [r.p_1, r.p_2, r.p_3]
        assert r.ensemble_p == pytest.approx(sum(ps) / 3) and 0 <= r.confidence <= 1
    top = training.best(training.scored(job, panel, "up_3d", last=2), 5).collect()
    assert len(top) == 5 and {r.date for r in top} == {dt.date(2020, 5, 29)} and top == sorted(top, key=lambda r: (-r.ensemble_p, r.ticker))
    with pytest.raises(ValueError, match="no fold"):
        training.scored(job, rows, "never")


def test_frames_of_the_report(job):
    shares = training.mean_importance(job).collect()
    assert sum(r.importance for r in shares) == pytest.approx(1) and {r.feature for r in shares} == set(job.features)
    bands = training.deciles(job).collect()
    assert sum(r["rows"] for r in bands) == 3 * 30 * 15 and all(r.band / 10 <= r.p_mean <= (r.band + 1) / 10 for r in bands)


def test_no_features_and_no_folds(spark, panel, tmp_path):
    with pytest.raises(ValueError, match="no feature"):
        training.train(panel.select("ticker", "date", "up_3d"), [training.Target("up_3d", 3)], f"file://{tmp_path}/a")
    few = training.train(panel.where("date < '2020-02-01'"), [training.Target("up_3d", 3)], f"file://{tmp_path}/b", cv=CV)
    assert few.fits.count() == few.predictions.count() == 0 and models.pattern_features(["x_zscore", "fwd_y_zscore"]) == ["x_zscore"]


def test_a_job_started_again_fits_only_what_is_missing(spark, panel, job, monkeypatch):
    root, fitted = job.root, []
    inner = training.fit_fold
    before = {(r.target, r.fold, r.ticker, r.date): r.p for r in job.predictions.collect()}
    for kind in ("fits", "predictions"):  # as if the driver had been lost before the figures were written
        sinks.discard(spark, f"{root}/{kind}/target=up_3d/fold=2")
    monkeypatch.setattr(training, "fit_fold", lambda *a: (fitted.append((a[2].column, a[3])), inner(*a))[1])
    again = training.train(panel, [training.Target("up_3d", 3), training.Target("never", 3)], root, b=BOOST, cv=CV)
    assert fitted == [("up_3d", 2)]
    after = {(r.target, r.fold, r.ticker, r.date): r.p for r in again.predictions.collect()}
    assert after.keys() == before.keys()


def test_tasks_of_the_panel_grow_with_its_rows(spark, monkeypatch):
    """The cross-section, whose sorts are the largest of a task, isn't left at the session's number of tasks."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(panels, "ROWS_A_TASK", 100)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    assert n > spark.sparkContext.defaultParallelism
    assert plans.normalised_panel(spark, sf).rdd.getNumPartitions() == n


def test_passes_of_a_fit_do_not_grow_with_the_rows(spark, panel, tmp_path, monkeypatch):
    """Four copies of all rows: the trees read the counts of the equal rows, which weigh four times as much."""
    seen, inner = [], GBTClassifier.fit
    monkeypatch.setattr(training, "DRAWS", 300)
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df, *a: (seen.append(df.where("not stops").selectExpr("count(*) AS n", "sum(weight) AS w").first()), inner(self, df, *a))[1])
    few = panel.where("date < '2020-04-01'")
    many = few.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("ticker", F.concat_ws("-", "ticker", "copy"))
    jobs = [training.train(df, [training.Target("up_3d", 3)], f"file://{tmp_path}/{k}", b=BOOST, cv=CV) for k, df in enumerate((few, many))]
    a, b = ([r.train_rows for r in job.fits.collect()] for job in jobs)
    assert len(a) == 1 and b == [4 * a[0]]
    assert seen[0].n <= a[0] and seen[1].n < 1.1 * seen[0].n and seen[0].w == pytest.approx(a[0]) and seen[1].w == pytest.approx(b[0])


def test_draws(spark, monkeypatch):
    monkeypatch.setattr(training, "DRAWS", 10)
    cells = spark.createDataFrame([(1, 13, False), (2, 1, False), (3, 40, True)], "bin int, n long, stops boolean")
    single = training.draws(cells, 10).groupBy("bin").agg(F.count("*").alias("k"), F.sum("of").alias("n"))
    assert {r.bin: (r.k, r.n) for r in single.collect()} == {1: (13, 13), 2: (1, 1), 3: (1, 40)}
    grouped = training.draws(cells, 34).groupBy("bin").agg(F.count("*").alias("k"), F.sum("of").alias("n"))
    assert {r.bin: (r.k, r.n) for r in grouped.collect()} == {1: (4, 13), 2: (1, 1), 3: (1, 40)}


def test_a_fit_is_that_of_the_rows(spark, panel):
    """Without draws and class weights, counts of equal rows give the trees that the rows give."""
    signal = F.coalesce((F.col("a_zscore") > 0.3) == (F.col("b_pctrank") > 0.4), F.lit(True)) == (F.xxhash64("ticker", "date") % 5 != 0)
    train = panel.select("a_zscore", "b_pctrank", signal.cast("double").alias("label"), (F.col("date") >= "2020-04-20").alias("stops"))
    n = train.where("not stops").count()
    positive = n / 2  # all weigh the same: Spark's splits are equal steps of weight, here of rows
    b = Boosting(trees=15, rate=0.1, depth=3, rows=1.0, features=1.0)
    filled = ["a_zscore_filled", "b_pctrank_filled"]
    plain = Pipeline(stages=[
        Imputer(strategy="median", inputCols=["a_zscore", "b_pctrank"], outputCols=filled, relativeError=b.median_error), VectorAssembler(inputCols=filled, outputCol="features"),
        GBTClassifier(labelCol="label", weightCol="weight", validationIndicatorCol="stops", maxIter=b.trees, maxDepth=b.depth, stepSize=b.rate, minInstancesPerNode=b.least_leaf, validationTol=b.tolerance, seed=b.seed),
    ]).fit(train.withColumn("weight", training.class_weight(F.col("label"), n, positive)))
    counted = training.fitted_trees(train, ("a_zscore", "b_pctrank"), b, n, positive)
    assert counted.stages[-1].getNumTrees == plain.stages[-1].getNumTrees > 1
    rows = panel.select("ticker", "date", "a_zscore", "b_pctrank")
    want, got = ({(r.ticker, r.date): r.p for r in models.probability(m.transform(rows)).select("ticker", "date", "p").collect()} for m in (plain, counted))
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_the_panel_is_made_once_for_a_job(spark, panel, job, tmp_path):
    """A job that is started again reads its rows, and so does who scores them."""
    unread = panel.withColumn("a_zscore", F.raise_error(F.lit("made again")).cast("double"))
    again = training.train(unread, [training.Target("up_3d", 3), training.Target("never", 3)], job.root, b=BOOST, cv=CV)
    assert again.rows.count() == panel.count()


def test_scores_of_a_sector_are_those_of_windows(spark):
    rng = random.Random(5)
    rows = [(f"t{k}", d, s, k % 7 > 0, rng.choice((1.0, 2.0, rng.gauss(0, 3))) if k % 5 else None, 2.0 if k % 3 else rng.random()) for d in (1, 2) for s, n in (("a", 40), ("b", 9), (None, 20)) for k in range(n)]
    df = spark.createDataFrame(rows, "ticker string, date int, sector string, in_universe boolean, x double, y double")
    made = ["x_zscore", "x_pctrank", "y_zscore", "y_pctrank"]
    want = cross.sector_normalised(cross.sector_normalised(df, "x"), "y")
    key = lambda r: (r.date, str(r.sector), r.ticker)
    a, b = (sorted(d.collect(), key=key) for d in (want, cross.sector_scores(df, ("x", "y"))))
    table = lambda rs: np.array([[r[m] for m in made] for r in rs], dtype=float)
    np.testing.assert_allclose(table(b), table(a), rtol=1e-12, atol=1e-12)
    assert sum(r.x_zscore is not None for r in b) > 40 and all(r.y_zscore is None for r in b)  # y's deviation is 0
