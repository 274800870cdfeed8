"""Targets, purged folds, metrics, ensembles, calibration, regimes by mixture models."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import columns as c
from quillon.operators import mixtures
from quillon.operators.quantiles import counts_below, exact_quantiles
from quillon.sources import sinks
from quillon.sources.panels import ROWS_A_TASK


def targets(df: DataFrame, horizon: int, thresholds: tuple[float, ...] = (0.05, 0.08)) -> DataFrame:
    """Direction of the forward log return, and simple returns beyond each threshold; NULL without a forward price."""
    ahead = F.ln(c.lag("close", -horizon) / F.col("close"))
    df = df.withColumn(f"fwd_ret_{horizon}d", ahead)
    simple = F.exp(f"fwd_ret_{horizon}d") - 1
    known = F.col(f"fwd_ret_{horizon}d").isNotNull()
    out = {f"target_up_{horizon}d": F.when(known, (F.col(f"fwd_ret_{horizon}d") > 0).cast("int"))}
    for t in thresholds:
        out |= {f"target_gain_{round(t * 100)}": F.when(known, (simple >= t).cast("int")), f"target_loss_{round(t * 100)}": F.when(known, (simple <= -t).cast("int"))}
    return df.withColumns(out)


def purged_folds(dates: DataFrame, k: int, horizon: int) -> DataFrame:
    """(``fold``, ``date``, ``part``) of an expanding walk-forward over distinct dates.

    A chunk is the floor of dates over ``k + 1``; fold ``i`` trains on the dates
    before its chunk less ``horizon``, and tests on the chunk, the last fold to
    the end. Too few dates give no fold. One row per date: the numbering is a
    window over the calendar.
    """
    n = dates.select("date").distinct().withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one")
    n = n.withColumns({"i": F.row_number().over(w.orderBy("date")) - 1, "d": F.count("*").over(w)}).where(F.col("d") >= (k + 1) * (horizon + 10))
    n = n.withColumn("size", F.floor(F.col("d") / (k + 1))).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.col("fold") * F.col("size")
    end = F.when(F.col("fold") == k, F.col("d")).otherwise(start + F.col("size"))
    part = F.when(F.col("i") < start - horizon, "train").when((F.col("i") >= start) & (F.col("i") < end), "test")
    return n.withColumn("part", part).where("part is not null").select("fold", "date", "part")


def walk_forward(dates: DataFrame, horizon: int, least_train: int = 504, size: int = 63, stop_share: float = 0.2) -> DataFrame:
    """(``fold``, ``date``, ``part``): validation blocks of ``size`` dates, training before them less a purge of ``horizon + 5``; the last share of it stops early."""
    n = dates.select("date").distinct().withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one")
    n = n.withColumns({"i": F.row_number().over(w.orderBy("date")) - 1, "d": F.count("*").over(w)})
    last = F.floor((F.col("d") - least_train) / size).cast("int")
    n = n.where(last >= 1).withColumn("fold", F.explode(F.sequence(F.lit(1), last)))
    start = F.lit(least_train) + (F.col("fold") - 1) * size
    cut = start - horizon - 5
    stop = F.floor(cut * (1 - stop_share))
    n = n.where(cut >= least_train // 2)
    part = F.when(F.col("i") < stop, "train").when(F.col("i") < cut, "early_stop").when((F.col("i") >= start) & (F.col("i") < start + size), "validation")
    return n.withColumn("part", part).where("part is not null").select("fold", "date", "part")


def metrics(df: DataFrame, keys: tuple[str, ...], label: str = "label", p: str = "p") -> DataFrame:
    """AUC by rank sums with average ties, log loss and Brier score per key. Values are counted before they are ranked, range by range."""
    each = df.where(F.col(label).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, p).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    each = counts_below(each, keys, p, "n")
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    neg = F.col("n") - F.col("pos")
    g = each.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("_r"), F.sum("pos").alias("_p"), F.sum("n").alias("n_rows"),
        (-F.sum(F.col("pos") * F.ln(q) + neg * F.ln(1 - q))).alias("_l"), F.sum(F.col("pos") * (F.col(p) - 1) ** 2 + neg * F.col(p) ** 2).alias("_b"),
    )
    auc = c.div(F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * (F.col("n_rows") - F.col("_p")))
    return g.select(*keys, "n_rows", auc.alias("auc"), (F.col("_l") / F.col("n_rows")).alias("log_loss"), (F.col("_b") / F.col("n_rows")).alias("brier"))


def across_folds(m: DataFrame) -> DataFrame:
    return m.agg(*[f(x).alias(f"{x}_{n}") for x in ("auc", "log_loss", "brier") for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp))])


def ensemble(df: DataFrame, columns: list[str], completeness: Column) -> DataFrame:
    """Mean of the known probabilities; confidence falls with their disagreement and with missing features."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(known), F.lit(0))
    df = df.withColumns({"_known": known, "ensemble_p": mean})
    spread = F.sqrt(F.aggregate("_known", F.lit(0.0), lambda s, x: s + (x - F.col("ensemble_p")) ** 2) / F.nullif(F.size("_known"), F.lit(0)))
    return df.withColumn("confidence", c.clip(1 - spread / 0.25, 0, 1) * 0.7 + completeness * 0.3).drop("_known")


def complete_share(columns: list[str]) -> Column:
    return sum((F.col(x).isNotNull().cast("int") for x in columns), F.lit(0)) / len(columns)


def pattern_features(columns: list[str], suffixes: tuple[str, ...] = ("_zscore", "_pctrank"), forbidden: str = "fwd_") -> list[str]:
    return [x for x in columns if x.endswith(suffixes) and not x.startswith(forbidden)]


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The lower median of each column, exact."""
    return {x: q[0] for x, q in exact_quantiles(df, {x: [0.5] for x in columns}, discrete=True).items()}


def filled(df: DataFrame, by: dict[str, float | None]) -> DataFrame:
    """Adds ``<column>_filled``: the value, or what ``by`` has for its column (NULL where that is None)."""
    return df.withColumns({f"{x}_filled": F.coalesce(x, F.lit(v).cast("double")) for x, v in by.items()})


def thresholds(df: DataFrame, columns: list[str], bins: int, most: int = 10_000, rows: int | None = None) -> dict[str, list[float]]:
    """At most ``bins - 1`` splits of each column, in equal steps of rows, as Spark's trees choose them.

    Trees look at a sample of 10,000 rows; here as many order statistics of all
    rows stand for it (all values, if there are no more rows). A split is the
    least double above the middle of two values, so that the middle itself lies
    left of it, as in a tree. ``rows`` saves the count where it is known.
    """
    n = min(df.count() if rows is None else rows, most)
    shares = F.split(F.lit(",".join(str((i + 0.5) / n) for i in range(n))), ",").cast("array<double>")  # one literal, where a list is one per number
    found = df.agg(*[F.percentile_approx(F.col(x).cast("double"), shares, 3 * most) for x in columns]).first() if n else [[] for _ in columns]
    out = {}
    for x, values in zip(columns, found, strict=True):
        counts: dict[float, int] = {}
        for v in sorted(values):
            counts[v] = counts.get(v, 0) + 1
        pairs = list(zip(counts, list(counts)[1:], strict=False))
        if len(pairs) > bins - 1:
            stride, at, kept = n / bins, 0, []
            target = stride
            for low, high in pairs:
                at += counts[low]
                if abs(at - target) < abs(at + counts[high] - target):
                    kept.append((low, high))
                    target += stride
            pairs = kept
        middles = [(low + high) / 2 for low, high in pairs]
        out[x] = sorted({math.nextafter(m, math.inf) for m in middles if math.isfinite(m)})
    return out


def bucketizer(df: DataFrame, columns: list[str], bins: int, rows: int | None = None) -> Bucketizer:
    """The bin of each column as ``<column>_bin``, by :func:`thresholds` of ``df``."""
    splits = thresholds(df, columns, bins, rows=rows)
    # A feature of one value has no split; a bucketizer needs one, and a tree can't use it.
    return Bucketizer(splitsArray=[[-math.inf, *(splits[x] or [0.0]), math.inf] for x in columns], inputCols=columns, outputCols=[f"{x}_bin" for x in columns], handleInvalid="skip")


def plain(columns: list[str]) -> list[Column]:
    """Bins as numbers: a bucketizer calls them categories."""
    return [F.col(x).alias(x, metadata={}) for x in columns]


@dataclass(frozen=True)
class BinnedTrees:
    """Boosted trees over counts of equal rows.

    Trees see a feature's bin only, so rows of the same bins and label are one
    row with their number as its weight. The passes of a fit, some for each
    level of each tree, then read a number of rows that few features bound
    (``bins ** len(features)`` for each label); of the table there are two.
    """

    features: tuple[str, ...]
    label: str
    trees: int = 20
    depth: int = 4
    bins: int = 32
    seed: int = 42

    def fit(self, df: DataFrame) -> PipelineModel:
        binned = [f"{x}_bin" for x in self.features]
        df = df.select(*self.features, self.label).dropna(subset=list(self.features))
        bucketed = bucketizer(df, list(self.features), self.bins)
        cells = sinks.stored(bucketed.transform(df).select(*plain(binned), self.label).groupBy(*binned, self.label).agg(F.count("*").cast("double").alias("weight")))
        # Sorted, so that sums don't hang on the order of a shuffle.
        cells = cells.repartition(-(-cells.count() // ROWS_A_TASK) or 1, *binned).sortWithinPartitions(*binned, self.label)
        assembler = VectorAssembler(inputCols=binned, outputCol="features")
        # Spark samples rows for splits beyond the square of maxBins: with 256, none of the cells of three features.
        boosting = GBTClassifier(labelCol=self.label, weightCol="weight", maxIter=self.trees, maxDepth=self.depth, maxBins=max(256, self.bins), seed=self.seed)
        return PipelineModel([bucketed, assembler, boosting.fit(assembler.transform(cells))])


def classifier(features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 42) -> BinnedTrees:
    return BinnedTrees(tuple(features), label, trees, depth, seed=seed)


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, weights), strict=True), key=lambda x: (-x[1], x[0]))


def probability(df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.get(vector_to_array("probability"), 1))


def out_of_fold(df: DataFrame, folds: DataFrame, estimator: BinnedTrees, parallel: int = 4) -> DataFrame:
    """``df``'s test rows of each fold with ``p`` of a model that was fitted on the fold's training dates; a fit for each fold.

    A few fits run at a time: each is many small jobs, most of whose time is not work of the cluster.
    """
    folds = sinks.stored(folds)  # a row per date and fold

    def found(k: int) -> DataFrame:
        own = folds.where(F.col("fold") == k)
        part = lambda x: df.join(own.where(F.col("part") == x).select("date"), "date", "left_semi")
        return probability(estimator.fit(part("train")).transform(part("test"))).withColumn("fold", F.lit(k))

    ks = [r.fold for r in folds.select("fold").distinct().orderBy("fold").collect()]
    if not ks:
        return df.limit(0).withColumns({"p": F.lit(None).cast("double"), "fold": F.lit(None).cast("int")})
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(df.sparkSession)(found), ks))


def calibrated(held: DataFrame, df: DataFrame, label: str = "label", p: str = "p", logistic: bool = False, out: str = "calibrated_p") -> DataFrame:
    """Probabilities through a fit on out-of-fold predictions: isotonic, or logistic on their log odds.

    Equal predictions are counted before the fit, whose passes read a row per prediction and label.
    """
    known = held.where(F.col(label).isNotNull() & F.col(p).isNotNull()).groupBy(label, p).agg(F.count("*").cast("double").alias("_n"))
    known = sinks.stored(known)
    rows = df.where(F.col(p).isNotNull())
    if not logistic:
        return IsotonicRegression(featuresCol=p, labelCol=label, weightCol="_n", predictionCol=out).fit(known).transform(rows)
    bounded = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda x: array_to_vector(F.array(F.ln(bounded / (1 - bounded))))
    model = LogisticRegression(featuresCol="_odds", labelCol=label, weightCol="_n", predictionCol="_class", probabilityCol="_both", rawPredictionCol="_raw").fit(known.withColumn("_odds", odds(p)))
    fitted = model.transform(rows.withColumn("_odds", odds(p)))
    return fitted.withColumn(out, F.get(vector_to_array("_both"), 1)).drop("_odds", "_class", "_both", "_raw")


class RegimeModel:
    """Clipped, scaled features to a mixture with diagonal covariances, its number of components chosen by BIC.

    Bounds are exact quantiles, the scale is the population's deviation; the fit
    takes all training rows, or with ``most_rows`` the first by a hash of their key.
    """

    def __init__(self, features: tuple[str, ...], fitting: mixtures.Fitting = mixtures.Fitting(), quantiles: tuple[float, float] = (0.01, 0.99), most_rows: int | None = None):
        self.features, self.fitting, self.quantiles, self.most_rows = features, fitting, quantiles, most_rows

    def ready(self) -> Column:
        out = F.lit(True)
        for x in self.features:
            out = out & F.col(x).isNotNull()
        return out

    def scaled(self) -> list[Column]:
        return [(c.clip(x, *self.bounds[x]) - self.means[x]) / self.deviations[x] for x in self.features]

    def fit(self, train: DataFrame) -> RegimeModel:
        rows = whole = sinks.stored(train.where(self.ready()).select("ticker", "date", *self.features))
        self.bounds = exact_quantiles(rows, {x: list(self.quantiles) for x in self.features})
        if self.most_rows is not None:
            rows = rows.orderBy(F.xxhash64(F.lit(self.fitting.seed), "ticker", "date"), "ticker", "date").limit(self.most_rows)
        clipped = {x: c.clip(x, *self.bounds[x]) for x in self.features if None not in self.bounds[x]}
        if len(clipped) < len(self.features):
            raise ValueError("no training row has all features")
        sums = rows.agg(*[f(v).alias(f"{n}{k}") for k, v in enumerate(clipped.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.means = {x: sums[f"m{k}"] for k, x in enumerate(self.features)}
        self.deviations = {x: sums[f"s{k}"] or 1.0 for k, x in enumerate(self.features)}
        scaled = sinks.stored(rows.select(F.array(*self.scaled()).alias("x")))
        sinks.dropped(whole)
        self.mixture = mixtures.fit(scaled, "x", self.fitting)
        sinks.dropped(scaled)
        self.chosen = self.mixture.k
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds label, confidence, log-likelihood and component probabilities; rows that miss a feature keep NULLs."""
        return mixtures.with_components(df, self.mixture, self.scaled())

    def scores(self, spark: SparkSession) -> DataFrame:
        """(``components``, ``bic``, ``aic``, ``log_likelihood``, ``chosen``) of the grid."""
        return spark.createDataFrame([(k, v["bic"], v["aic"], v["log_likelihood"], k == self.chosen) for k, v in self.mixture.scores.items()], "components int, bic double, aic double, log_likelihood double, chosen boolean")
