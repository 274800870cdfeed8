"""Gaussian mixtures with diagonal covariances: expectation and maximisation over a distributed table.

One pass over the rows serves every open model, all numbers of components and
all starts: a task sums, over its rows, what the new parameters need (weights,
weighted values and squares per component, and the log-likelihood), and the sums
of the tasks are added up on the executors. So the driver holds parameters only,
and a grid of models costs as many passes as its slowest member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fitting:
    """``seed_rows``: rows, the first by a hash, among which starts are chosen; the fit takes all. ``hard``: passes with whole memberships, before weighted ones."""

    components: tuple[int, ...] = (3, 4, 5, 6)
    starts: int = 3
    passes: int = 200
    tolerance: float = 1e-3
    floor: float = 1e-6
    hard: int = 5
    seed_rows: int = 10_000
    seed: int = 42


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    log_likelihood: float = -math.inf  # mean over rows
    rows: int = 0
    passes: int = 0
    converged: bool = False
    scores: dict[int, dict[str, float]] = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def free(self) -> int:
        """Free parameters: means, variances and weights."""
        return 2 * self.means.size + self.k - 1

    @property
    def bic(self) -> float:
        return self.free * math.log(self.rows) - 2 * self.log_likelihood * self.rows

    @property
    def aic(self) -> float:
        return 2 * self.free - 2 * self.log_likelihood * self.rows

    def log_joint(self, moments: np.ndarray) -> np.ndarray:
        """Log of weight times density, components by rows: linear in what :func:`moments` gives."""
        precise = 1 / self.variances
        level = np.log(self.weights) - 0.5 * ((self.means**2 * precise).sum(1) + np.log(self.variances).sum(1) + self.means.shape[1] * math.log(2 * math.pi))
        return np.concatenate([level[:, None], self.means * precise, -0.5 * precise], 1) @ moments

    def sums(self, moments: np.ndarray, hard: bool) -> np.ndarray:
        """What :meth:`stepped` needs, as one vector that adds up over rows."""
        share = self.log_joint(moments)
        top = share.max(0)
        best = share.argmax(0) if hard else None
        share -= top
        np.exp(share, out=share)
        total = share.sum(0)
        if hard:
            share = (best == np.arange(self.k)[:, None]).astype(float)
        else:
            share /= total
        by = share @ moments.T
        d = self.means.shape[1]
        return np.concatenate([by[:, 0], by[:, 1 : d + 1].ravel(), by[:, d + 1 :].ravel(), [(top + np.log(total)).sum(), moments.shape[1]]])

    def stepped(self, sums: np.ndarray, floor: float) -> Mixture:
        """The next parameters; ``log_likelihood`` is that of the present ones. A component without rows stays where it is, at no weight."""
        k, d = self.means.shape
        n = sums[:k] + 10 * np.finfo(float).eps
        means = np.where(sums[:k, None] > 0, sums[k : k + k * d].reshape(k, d) / n[:, None], self.means)
        variances = np.where(sums[:k, None] > 0, sums[k + k * d : k + 2 * k * d].reshape(k, d) / n[:, None] - means**2, self.variances)
        return Mixture(n / n.sum(), means, np.maximum(variances, 0) + floor, sums[-2] / sums[-1], int(sums[-1]), self.passes + 1)


def moments(x: np.ndarray) -> np.ndarray:
    """One, the values and their squares, a row each: made once per block, for all models."""
    return np.concatenate([np.ones((1, len(x))), x.T, x.T**2])


def seeded(sample: np.ndarray, k: int, rng: np.random.Generator) -> Mixture:
    """A start: centres far from each other (each drawn by its squared distance to those before), one spread, equal weights."""
    centres = [sample[rng.integers(len(sample))]]
    for _ in range(k - 1):
        far = np.min([((sample - c) ** 2).sum(1) for c in centres], 0)
        centres.append(sample[rng.choice(len(sample), p=far / far.sum())] if far.sum() > 0 else centres[0])
    return Mixture(np.full(k, 1 / k), np.array(centres), np.tile(np.maximum(sample.var(0), 1e-6), (k, 1)))


def summed(rows: DataFrame, models: dict[int, tuple[Mixture, bool]], x: str) -> dict[int, np.ndarray]:
    """One pass: the sums of every model over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            values = b.column(0)
            if len(values):
                block = moments(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1))
                for key, (m, hard) in models.items():
                    own = m.sums(block, hard)
                    totals[key] = own if key not in totals else totals[key] + own
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["model", "sums"])

    parts = rows.select(x).mapInArrow(run, "model int, sums array<double>")
    each = parts.select("model", F.posexplode("sums").alias("at", "v")).groupBy("model", "at").agg(F.sum("v").alias("v"))
    found: dict[int, list[tuple[int, float]]] = {}
    for r in each.collect():
        found.setdefault(r["model"], []).append((r["at"], r["v"]))
    return {key: np.array([v for _, v in sorted(own)]) for key, own in found.items()}


def fit(rows: DataFrame, x: str, f: Fitting = Fitting()) -> Mixture:
    """The mixture with the least BIC of all numbers of components, each the best of its starts by likelihood.

    ``x`` is an array of doubles without nulls; ``rows`` is read in every pass.
    ``scores`` has BIC, AIC and the mean log-likelihood by number of components.
    """
    sample = np.array([r[0] for r in rows.select(x).orderBy(F.xxhash64(F.lit(f.seed), x), x).limit(f.seed_rows).collect()])
    if not len(sample):
        raise ValueError("no row to fit")
    rng = np.random.default_rng(f.seed)
    open_ = {s * len(f.components) + c: seeded(sample, k, rng) for s in range(f.starts) for c, k in enumerate(f.components)}
    done: dict[int, Mixture] = {}
    for step in range(f.hard + f.passes):
        hard = step < f.hard
        sums = summed(rows, {key: (m, hard) for key, m in open_.items()}, x)
        for key, m in list(open_.items()):
            new = m.stepped(sums[key], f.floor)
            # The sums give the likelihood of the parameters that went in; those are kept when it no longer rises.
            if not hard and new.log_likelihood - m.log_likelihood < f.tolerance and step > f.hard:
                m.log_likelihood, m.rows, m.converged = new.log_likelihood, new.rows, True
                done[key] = open_.pop(key)
            else:
                open_[key] = new
        if not open_:
            break
    for key, sums in (summed(rows, {k: (m, False) for k, m in open_.items()}, x) if open_ else {}).items():
        m = open_[key]
        m.log_likelihood, m.rows = sums[-2] / sums[-1], int(sums[-1])
        done[key] = m
    best = {k: max((m for m in done.values() if m.k == k), key=lambda m: m.log_likelihood) for k in f.components}
    chosen = min(best.values(), key=lambda m: m.bic)
    chosen.scores = {k: {"bic": float(m.bic), "aic": float(m.aic), "log_likelihood": float(m.log_likelihood)} for k, m in best.items()}
    return chosen


def with_components(df: DataFrame, m: Mixture, xs: list[Column], prefix: str = "gmm") -> DataFrame:
    """Adds label, confidence, log-likelihood and probabilities of a row, as expressions; NULL where one of ``xs`` is missing."""
    joints = []
    for w, mean, var in zip(m.weights, m.means, m.variances, strict=True):
        squares = [(x - float(a)) * (x - float(a)) / float(v) for x, a, v in zip(xs, mean, var, strict=True)]
        joints.append(F.lit(float(math.log(w) - 0.5 * (np.log(var).sum() + len(mean) * math.log(2 * math.pi)))) - sum(squares[1:], squares[0]) / 2)
    df = df.withColumn("_joint", F.when(joints[0].isNotNull(), F.array(*joints))).withColumn("_top", F.array_max("_joint"))
    likelihood, top = F.col(f"{prefix}_log_likelihood"), F.col("_top")
    df = df.withColumn(f"{prefix}_log_likelihood", top + F.ln(F.aggregate("_joint", F.lit(0.0), lambda s, j: s + F.exp(j - top))))
    df = df.withColumns({
        f"{prefix}_regime_label": (F.array_position("_joint", top) - 1).cast("double"), f"{prefix}_regime_confidence": F.exp(top - likelihood),
        **{f"{prefix}_regime_prob_{k}": F.exp(F.get("_joint", F.lit(k)) - likelihood) for k in range(m.k)},
    })
    return df.drop("_joint", "_top")
