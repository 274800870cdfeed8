"""Hidden Markov models with Gaussian states, and their refits over an expanding series.

The forward and the backward pass are scans of an associative product: a step
is a k x k matrix (transition times density), steps multiply to blocks, a scan
over the blocks carries the vector, and blocks are then filled in, all of them
at once. So a pass over n steps is about 2 * block + n / block small operations
instead of n.

A refit takes all rows up to its end, whatever the other refits take, so each is
a task of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources import sinks


@dataclass
class Markov:
    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = -math.inf
    passes: int = 0

    @property
    def k(self) -> int:
        return len(self.start)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.k))
        for j in range(self.k):
            root = np.linalg.cholesky(self.covariances[j])
            z = np.linalg.solve(root, (x - self.means[j]).T)
            out[:, j] = -0.5 * ((z**2).sum(0) + x.shape[1] * math.log(2 * math.pi)) - np.log(np.diag(root)).sum()
        return out

    def steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each step's matrix, its largest density divided out, and the logarithms of those. The first step leads from anywhere to the start."""
        logs = self.log_density(x)
        top = logs.max(1)
        density = np.exp(logs - top[:, None])
        out = self.move[None] * density[:, None, :]
        out[0] = self.start[None] * density[0][None]
        return out, top


def scanned(steps: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray, float]:
    """Normalised forward and backward vectors of all steps, and the logarithm of the whole product's sum."""
    n, k = steps.shape[:2]
    count = -(-n // block)
    padded = np.concatenate([steps, np.tile(np.eye(k), (count * block - n, 1, 1))]).reshape(count, block, k, k)

    prefix, logs = np.empty_like(padded), np.zeros((count, block))
    run, log = np.tile(np.eye(k), (count, 1, 1)), np.zeros(count)
    for at in range(block):
        run = run @ padded[:, at]
        size = run.max((1, 2))
        run = run / size[:, None, None]
        log = log + np.log(size)
        prefix[:, at], logs[:, at] = run, log
    suffix = np.empty_like(padded)
    run = np.tile(np.eye(k), (count, 1, 1))
    for at in range(block - 1, -1, -1):
        suffix[:, at] = run  # what follows the step within its block
        run = padded[:, at] @ run
        run = run / run.max((1, 2))[:, None, None]

    before, total = np.empty((count, k)), 0.0
    v = np.full(k, 1 / k)
    for b in range(count):
        before[b] = v
        v = v @ prefix[b, -1]
        total += logs[b, -1] + math.log(v.sum())
        v = v / v.sum()
    after = np.empty((count, k))
    v = np.ones(k)
    for b in range(count - 1, -1, -1):
        after[b] = v
        v = padded[b, 0] @ suffix[b, 0] @ v
        v = v / v.max()
    forward = np.einsum("bi,btij->btj", before, prefix).reshape(-1, k)[:n]
    backward = np.einsum("btij,bj->bti", suffix, after).reshape(-1, k)[:n]
    return forward / forward.sum(1, keepdims=True), backward / backward.max(1, keepdims=True), total


def posterior(m: Markov, x: np.ndarray, block: int = 64) -> tuple[np.ndarray, float]:
    """Probabilities of states at each row given all rows, and the log-likelihood."""
    steps, top = m.steps(x)
    forward, backward, log = scanned(steps, block)
    both = forward * backward
    return both / both.sum(1, keepdims=True), log + top.sum()


def likeliest(m: Markov, x: np.ndarray) -> np.ndarray:
    """The likeliest sequence of states (the lowest number among equals)."""
    with np.errstate(divide="ignore"):
        move, score = np.log(m.move), np.log(m.start)
    logs = m.log_density(x)
    score, back = score + logs[0], np.zeros(logs.shape, int)
    for t in range(1, len(x)):
        ways = score[:, None] + move
        back[t] = ways.argmax(0)
        score = ways.max(0) + logs[t]
    out = np.empty(len(x), int)
    out[-1] = score.argmax()
    for t in range(len(x) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def centres(x: np.ndarray, k: int, seed: int, passes: int = 50) -> np.ndarray:
    """k means, from centres that are far from each other."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        far = np.min([((x - v) ** 2).sum(1) for v in c], 0)
        c.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else c[0])
    c = np.array(c)
    for _ in range(passes):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c


def fit(x: np.ndarray, k: int = 4, passes: int = 200, tolerance: float = 1e-2, floor: float = 1e-3, seed: int = 42) -> Markov:
    """Baum-Welch until the log-likelihood rises by less than ``tolerance``; ``floor`` is added to all variances."""
    d = x.shape[1]
    spread = np.cov(x.T, bias=True).reshape(d, d) + floor * np.eye(d)
    m = Markov(np.full(k, 1 / k), np.full((k, k), 1 / k), centres(x, k, seed), np.tile(spread, (k, 1, 1)))
    for step in range(passes):
        steps, top = m.steps(x)
        forward, backward, log = scanned(steps)
        both = forward * backward
        share = both / both.sum(1, keepdims=True)
        pairs = forward[:-1, :, None] * steps[1:] * backward[1:, None, :]
        moved = (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)
        log += top.sum()
        risen = log - m.log_likelihood
        m.log_likelihood, m.passes = log, step
        if risen < tolerance:
            break
        n = share.sum(0) + 1e-12
        means = (share.T @ x) / n[:, None]
        covariances = np.array([((x - means[j]).T * share[:, j]) @ (x - means[j]) / n[j] for j in range(k)]) + floor * np.eye(d)
        rows = moved.sum(1, keepdims=True)
        m = Markov(share[0], np.where(rows > 0, moved / np.maximum(rows, 1e-300), 1 / k), means, covariances, log, step)
    return m


def expanding_regimes(df: DataFrame, features: tuple[str, ...], k: int = 4, least_train: int = 252, every: int = 63, seed: int = 42) -> DataFrame:
    """A hidden Markov model refitted every ``every`` rows of a series; each segment is labelled by the fit on all rows up to its end.

    (``date``, ``regime_state``, ``regime_prob_<j>``, ``fitted_rows``,
    ``log_likelihood``). As in the method it follows, segments are in-sample and
    state numbers aren't aligned across fits. Values are scaled by the mean and
    deviation of the rows fitted on. A row goes to each later refit, one group
    each: the series is one of dates, and doesn't grow with instruments.
    """
    w = Window.partitionBy("_one").orderBy("date")
    known = df.where(sum((F.col(x).isNull().cast("int") for x in features), F.lit(0)) == 0).withColumn("_one", F.lit(1)).select("date", *features, (F.row_number().over(w) - 1).alias("_i"))
    known = sinks.stored(known)
    n = known.count()
    ends = sorted({*range(least_train, n + 1, every), n}) if n >= least_train else []
    schema = "date date, regime_state int, " + ", ".join(f"regime_prob_{j} double" for j in range(k)) + ", fitted_rows int, log_likelihood double"
    if not ends:
        return df.sparkSession.createDataFrame([], schema)
    before = dict(zip(ends, [0, *ends[:-1]], strict=True))

    def refit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_i")
        end = int(own["_end"].iloc[0])
        x = own[list(features)].to_numpy(float)
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
        m = fit(x, k, seed=seed)
        segment = slice(before[end], end)
        share, _ = posterior(m, x[segment])
        out = pd.DataFrame({"date": own["date"].iloc[segment], "regime_state": likeliest(m, x[segment])})
        for j in range(k):
            out[f"regime_prob_{j}"] = share[:, j]
        return out.assign(fitted_rows=end, log_likelihood=m.log_likelihood)

    later = F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e > F.col("_i"))
    # One task per refit: the fits are independent, and the later ones are the longer.
    return known.withColumn("_end", F.explode(later)).repartition(len(ends), "_end").groupBy("_end").applyInPandas(refit, schema)
