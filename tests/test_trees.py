"""Boosted trees over counts of equal rows: the same model as Spark's over the rows, from fewer of them."""

from __future__ import annotations

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from quillon.operators import models

FEATURES = ["a", "b", "flag", "same"]


@pytest.fixture(scope="module")
def rows(spark):
    """A signal, a bounded feature of which a third is its bound, and a flag that one row in two hundred has, one value for all; some values missing."""
    rng, out = random.Random(3), []
    for k in range(3000):
        a, b, flag = rng.gauss(0, 1), min(0.0, rng.uniform(-2, 1)), float(k % 200 == 1)
        p = 0.95 if flag else 0.7 if a * b < -0.2 else 0.3
        out.append((k, a if k % 50 else None, b if k % 70 else float("nan"), flag, float(rng.random() < p)))
    return spark.createDataFrame(out, "id long, a double, b double, flag double, label double").withColumn("same", F.lit(3.0)).repartition(3).cache()


@pytest.fixture
def fitted_rows(monkeypatch):
    """Numbers of rows that Spark's fits get."""
    seen = []
    for kind in (GBTClassifier, IsotonicRegression):
        inner = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, df, *a, inner=inner: (seen.append(df.count()), inner(self, df, *a))[1])
    return seen


def test_the_model_is_that_of_the_rows(rows):
    plain = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip"), GBTClassifier(labelCol="label", maxIter=20, maxDepth=4, seed=42)]).fit(rows)
    binned = models.classifier(FEATURES, "label").fit(rows)
    want, got = ({r.id: r.p for r in models.probability(m.transform(rows)).select("id", "p").collect()} for m in (plain, binned))
    assert len(want) > 2800 and got.keys() == want.keys() and len(set(want.values())) > 100
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert dict(models.importance(binned, FEATURES)) == pytest.approx(dict(models.importance(plain, FEATURES)))


def test_a_fit_gets_no_more_rows_when_the_table_grows(rows, fitted_rows):
    estimator = models.classifier(FEATURES, "label", trees=2, depth=2)
    few = estimator.fit(rows)
    many = estimator.fit(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3)))))
    assert fitted_rows[0] == fitted_rows[1] < rows.count()
    want, got = ({r.id: r.p for r in models.probability(m.transform(rows)).collect()} for m in (few, many))
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_thresholds_beyond_the_values_that_are_looked_at(spark):
    """With more rows than order statistics, splits lie at equal steps of all rows."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("x"), F.lit(1.0).alias("same"))
    found = models.thresholds(df, ["x", "same"], 32, most=1000)
    assert found["same"] == [] and len(found["x"]) == 31
    assert all(abs(t - 625 * k) <= 60 for k, t in enumerate(found["x"], 1))
    assert models.thresholds(df.limit(0), ["x"], 32) == {"x": []}


def test_calibration_counts_equal_predictions(spark, fitted_rows):
    held = spark.createDataFrame([(float(k % 10 < (6 if p > 0.5 else 4)), p) for p in (0.1, 0.9) for k in range(200)], "label double, p double")
    got = {r.p: r.calibrated_p for r in models.calibrated(held, spark.createDataFrame([(0.1,), (0.9,)], "p double")).collect()}
    assert got == {0.1: pytest.approx(0.4), 0.9: pytest.approx(0.6)}
    assert fitted_rows == [4]
