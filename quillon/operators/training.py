"""Boosted trees over folds and targets: early stopping, class weights, kept fold models, ensembles.

A job of (target, fold) fits. Each is a Spark ML fit over counts of the whole
panel's equal rows of its fold, so the rows are never in one task, and the
passes of its trees don't grow with them; a few fits run at a time, from
threads of the driver, so that the cluster isn't idle between the small jobs of
a tree. A fit writes its model, its predictions of the validation block and its
figures below the job's root, the figures last. A job that is started again
leaves out what has its figures, so a lost driver costs the fits under way.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Boosting, CrossValidation
from quillon.operators import models
from quillon.sources import sinks

FITS = "target string, fold int, status string, train_rows long, stop_rows long, validation_rows long, train_rate double, validation_rate double, trees int, most_trees int, train_end date, validation_start date, validation_end date"
PREDICTIONS = "target string, fold int, ticker string, date date, label double, p double"
IMPORTANCE = "target string, fold int, feature string, importance double"


@dataclass(frozen=True)
class Target:
    """A 0/1 column and how many dates ahead it looks, which is what folds are purged by."""

    column: str
    horizon: int


@dataclass(frozen=True)
class Trained:
    """The tables of a job and where its fold models are."""

    root: str
    features: tuple[str, ...]
    rows: DataFrame
    predictions: DataFrame
    fits: DataFrame
    importance: DataFrame

    def model_path(self, target: str, fold: int) -> str:
        return f"{self.root}/model/target={target}/fold={fold}"

    def folds(self, target: str) -> list[int]:
        return [r.fold for r in self.fits.where((F.col("target") == target) & (F.col("status") == "fitted")).select("fold").orderBy("fold").collect()]


def complete_rows(panel: DataFrame, features: Iterable[str], least_share: float) -> DataFrame:
    """Rows that have at least this share of the features."""
    return panel.where(models.complete_share(list(features)) >= least_share)


#: Training rows of a fit that stand for themselves; beyond, equal rows are drawn together, so many at a time that there are as many draws.
DRAWS = 200_000
#: Counts that a task of a fit's passes reads.
CELLS_A_TASK = 50_000


def draws(cells: DataFrame, rows: int) -> DataFrame:
    """Counts of equal training rows (``n``) as draws of equal weight (``of`` rows each): as many as ``rows``, or ``DRAWS`` and one for each cell."""
    size = -(-rows // DRAWS) or 1
    times = F.when(F.col("stops"), 1).otherwise(F.ceil(F.col("n") / size)).cast("int")
    return cells.withColumns({"of": F.col("n") / times, "_draw": F.explode(F.sequence(F.lit(1), times))}).drop("_draw", "n")


def fitted_trees(train: DataFrame, features: tuple[str, ...], b: Boosting, rows: int, positive: int) -> PipelineModel:
    """Medians for what is missing, bins, one vector, boosted trees that stop when the marked rows' loss stops falling.

    ``train`` has the features, ``label`` and ``stops``; ``rows`` and
    ``positive`` count those that aren't marked. Trees see a feature's bin only,
    so that rows of the same bins, label and mark are counted, and the passes of
    a fit, some for each level of each tree, read the counts. A tree draws its
    share of rows singly up to ``DRAWS`` of them, and beyond in groups of equal
    rows that grow with the table; a leaf has its least number of draws.
    """
    filled = [f"{x}_filled" for x in features]
    binned = [f"{x}_bin" for x in filled]
    imputer = Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=b.median_error).fit(train)
    whole = imputer.transform(train)
    bucketed = models.bucketizer(whole.where(~F.col("stops")), filled, b.bins, rows)
    cells = sinks.stored(bucketed.transform(whole).select(*models.plain(binned), "label", "stops").groupBy(*binned, "label", "stops").agg(F.count("*").alias("n")))
    drawn = draws(cells, rows)
    # Sorted, so that draws and sums don't hang on the order of a shuffle.
    drawn = drawn.repartition(-(-drawn.count() // CELLS_A_TASK), *binned).sortWithinPartitions(*binned, "label", "stops")
    assembler = VectorAssembler(inputCols=binned, outputCol="features")
    boosting = GBTClassifier(
        # Spark samples rows for splits beyond the square of maxBins: here, it sees a million.
        labelCol="label", weightCol="weight", validationIndicatorCol="stops", maxIter=b.trees, maxDepth=b.depth, maxBins=max(1024, b.bins), stepSize=b.rate, minInstancesPerNode=b.least_leaf,
        subsamplingRate=b.rows, featureSubsetStrategy=str(b.features), validationTol=b.tolerance, seed=b.seed,
    )
    weighted = drawn.withColumn("weight", F.col("of") * class_weight(F.col("label"), rows, positive))
    return PipelineModel([imputer, bucketed, assembler, boosting.fit(assembler.transform(weighted))])


def class_weight(label: Column, n: int, positive: int) -> Column:
    """Each class weighs half of all rows."""
    return F.when(label == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive)))


def fit_fold(panel: DataFrame, dates: DataFrame, target: Target, fold: int, features: tuple[str, ...], b: Boosting, cv: CrossValidation, root: str) -> None:
    """One fit. A fold whose training or validation part has one class only, or too few rows, gets figures without a model.

    ``dates`` has ``date`` and ``part`` of each ``fold``, and the target's rows (``n``) and ``positive`` ones of the date.
    """
    spark = panel.sparkSession
    at = lambda kind: f"{root}/{kind}/target={target.column}/fold={fold}"
    own = panel.where(F.col(target.column).isNotNull()).select("ticker", "date", *features, F.col(target.column).cast("double").alias("label"))
    dates = dates.where(F.col("fold") == fold)
    own = own.join(dates.select("date", "part"), "date")
    sums = {r.part: r for r in dates.groupBy("part").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"), F.min("date").alias("low"), F.max("date").alias("high")).collect()}
    n = lambda part: sums[part].n if part in sums else 0
    rate = lambda part: sums[part].positive / sums[part].n if n(part) else None
    trees = None
    status = "few rows" if min(n("train"), n("validation")) < cv.least_rows else "one class" if {rate("train"), rate("validation")} & {0.0, 1.0} else "fitted"
    if status == "fitted":
        # Too few rows to stop by: the validation block stops the fit, as it would where no part was set apart.
        stop = "early_stop" if n("early_stop") >= cv.least_stop_rows else "validation"
        train = own.where(F.col("part").isin("train", stop)).withColumn("stops", F.col("part") == stop)
        fitted = fitted_trees(train, features, b, n("train"), int(sums["train"].positive))
        sinks.model(fitted, at("model"))
        trees = fitted.stages[-1].getNumTrees
        found = models.probability(fitted.transform(own.where("part = 'validation'")))
        sinks.parquet(found.select("ticker", "date", "label", "p"), at("predictions"))
        shares = [(x, float(v)) for x, v in models.importance(fitted, list(features))]
        sinks.parquet(spark.createDataFrame(shares, "feature string, importance double").coalesce(1), at("importance"))
    edge = lambda part, side: getattr(sums[part], side) if n(part) else None
    row = (status, n("train"), n("early_stop"), n("validation"), rate("train"), rate("validation"), trees, b.trees, edge("train", "high"), edge("validation", "low"), edge("validation", "high"))
    sinks.parquet(spark.createDataFrame([row], FITS.split(", ", 2)[2]).coalesce(1), at("fits"))


def train(panel: DataFrame, targets: list[Target], root: str, features: tuple[str, ...] | None = None, b: Boosting = Boosting(), cv: CrossValidation = CrossValidation(), parallel: int = 4) -> Trained:
    """Fits every (target, fold) that ``root`` doesn't hold yet.

    ``panel`` has (``ticker``, ``date``), the targets and the features; by
    default the features are picked by the pattern of normalised columns. Folds
    are blocks of ``cv.block`` dates after at least ``cv.least_train`` dates;
    training ends ``horizon + 5`` dates before, its last fifth stops the fit.
    The complete rows are kept below the root, too: the same root must not be
    used with another panel.
    """
    spark = panel.sparkSession
    features = features or tuple(models.pattern_features(panel.columns))
    if not features:
        raise ValueError("no feature: name them, or give columns that end in _zscore or _pctrank")
    names = [t.column for t in targets]
    rows = complete_rows(panel, features, cv.least_features).select("ticker", "date", *features, *names)
    if not sinks.complete(spark, f"{root}/rows"):
        sinks.parquet(rows, f"{root}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    work = []
    for t in targets:
        # A row per date and fold, whatever the number of instruments.
        daily = sinks.stored(rows.where(F.col(t.column).isNotNull()).groupBy("date").agg(F.count("*").alias("n"), F.sum(F.col(t.column).cast("double")).alias("positive")))
        dates = sinks.stored(models.walk_forward(daily.select("date"), t.horizon, cv.least_train, cv.block).join(daily, "date"))
        for fold in [r.fold for r in dates.select("fold").distinct().orderBy("fold").collect()]:
            if not sinks.complete(spark, f"{root}/fits/target={t.column}/fold={fold}"):
                work.append((dates, t, fold))
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        one = inheritable_thread_target(spark)(lambda w: fit_fold(rows, w[0], w[1], w[2], features, b, cv, root))
        for _ in pool.map(one, work):  # raises what a fit raised
            pass
    return trained(spark, root, features, rows)


def trained(spark: SparkSession, root: str, features: tuple[str, ...], rows: DataFrame) -> Trained:
    """The tables of what was fitted below ``root``; empty ones where nothing was."""

    def table(kind: str, schema: str) -> DataFrame:
        if not sinks.exists(spark, f"{root}/{kind}"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{root}/{kind}").select(*[x.split()[0] for x in schema.split(", ")])

    return Trained(root, features, rows, table("predictions", PREDICTIONS), table("fits", FITS), table("importance", IMPORTANCE))


def fold_metrics(t: Trained) -> DataFrame:
    """AUC, log loss and Brier score of each target's folds beside the figures of the fits."""
    m = models.metrics(t.predictions, ("target", "fold"))
    return t.fits.join(m.drop("n_rows"), ["target", "fold"], "left")


def report(t: Trained) -> DataFrame:
    """One row per target: folds that were fitted, and each metric's mean, median and deviation over them."""
    m = fold_metrics(t).where("status = 'fitted'")
    return m.groupBy("target").agg(F.count("*").alias("folds"), F.sum("validation_rows").alias("rows"), F.avg("trees").alias("trees_mean"), *[f(x).alias(f"{x}_{n}") for x in ("auc", "log_loss", "brier") for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp))])


def mean_importance(t: Trained) -> DataFrame:
    """(``target``, ``feature``): the mean share over folds, and in how many folds it is above 0."""
    return t.importance.groupBy("target", "feature").agg(F.avg("importance").alias("importance"), F.sum((F.col("importance") > 0).cast("int")).alias("folds_used"))


def deciles(t: Trained, n: int = 10) -> DataFrame:
    """Distribution of predictions: for each target and band of probability, the rows, the mean prediction and the rate of the label."""
    band = F.least(F.floor(F.col("p") * n), F.lit(n - 1)).cast("int")
    return t.predictions.groupBy("target", band.alias("band")).agg(F.count("*").alias("rows"), F.avg("p").alias("p_mean"), F.avg("label").alias("label_rate"))


def scored(t: Trained, rows: DataFrame, target: str, last: int | None = None) -> DataFrame:
    """``rows`` with ``p_<fold>`` of each kept fold model (the ``last`` of them), their mean and the confidence in it.

    Each model is a transform of the same rows, without a shuffle; one that
    misses a feature fills in its own fold's median.
    """
    folds = t.folds(target)[-last if last else None :]
    if not folds:
        raise ValueError(f"no fold of {target} was fitted")
    keep = rows.columns

    def step(df: DataFrame, fold: int) -> DataFrame:
        fitted = PipelineModel.load(t.model_path(target, fold))
        return models.probability(fitted.transform(df)).withColumnRenamed("p", f"p_{fold}").select(*df.columns, f"p_{fold}")

    names = [f"p_{k}" for k in folds]
    out = reduce(step, folds, rows)
    return models.ensemble(out, names, models.complete_share(list(t.features))).select(*keep, *names, "ensemble_p", "confidence")


def best(scores: DataFrame, n: int = 20) -> DataFrame:
    """The report's top rows of the latest date: highest mean probability, then ticker."""
    latest = scores.agg(F.max("date").alias("date"))
    return scores.join(latest, "date").orderBy(F.desc("ensemble_p"), "ticker").limit(n)
