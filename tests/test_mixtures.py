"""Mixtures and hidden Markov models against plain loops; exact quantiles and ranks against sorting."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import markov, mixtures, models
from quillon.operators.quantiles import counts_below, exact_quantiles


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    return np.concatenate([rng.normal(m, s, (n, 2)) for m, s, n in ((-3, 0.7, 120), (0, 1.0, 200), (4, 0.5, 80))])


def density(x, mean, var):
    return math.prod(math.exp(-((a - m) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v) for a, m, v in zip(x, mean, var, strict=True))


def plain_em(rows, start, hard, tolerance, floor):
    """Expectation and maximisation by definition, row by row."""
    w, mu, var = start.weights.tolist(), start.means.tolist(), start.variances.tolist()
    k, d, before = len(w), len(mu[0]), -math.inf
    for step in itertools.count():
        share, total = [], 0.0
        for x in rows:
            each = [w[j] * density(x, mu[j], var[j]) for j in range(k)]
            total += math.log(sum(each))
            share.append([float(j == max(range(k), key=each.__getitem__)) for j in range(k)] if step < hard else [e / sum(each) for e in each])
        mean = total / len(rows)
        if step > hard and mean - before < tolerance:
            return w, mu, var, mean
        before = mean
        n = [sum(s[j] for s in share) + 10 * np.finfo(float).eps for j in range(k)]
        mu = [[sum(s[j] * x[c] for s, x in zip(share, rows, strict=True)) / n[j] for c in range(d)] for j in range(k)]
        var = [[sum(s[j] * x[c] ** 2 for s, x in zip(share, rows, strict=True)) / n[j] - mu[j][c] ** 2 + floor for c in range(d)] for j in range(k)]
        w = [v / sum(n) for v in n]


def test_mixture_equals_plain_em(spark, cloud):
    f = mixtures.Fitting(components=(2, 3), starts=1, hard=2)
    df = spark.createDataFrame([(x.tolist(),) for x in cloud], "x array<double>").repartition(5)
    sample = np.array([r.x for r in df.orderBy(F.xxhash64(F.lit(f.seed), "x"), "x").collect()])
    rng = np.random.default_rng(f.seed)
    found = mixtures.fit(df, "x", f)
    for k in (2, 3):
        w, mu, var, mean = plain_em(cloud.tolist(), mixtures.seeded(sample, k, rng), f.hard, f.tolerance, f.floor)
        assert found.scores[k]["log_likelihood"] == pytest.approx(mean, abs=1e-6)
        free = 2 * k * 2 + k - 1
        assert found.scores[k]["bic"] == pytest.approx(free * math.log(400) - 2 * 400 * mean, abs=1e-3)
        assert found.scores[k]["aic"] == pytest.approx(2 * free - 2 * 400 * mean, abs=1e-3)
    assert found.k == 3 and found.converged
    assert found.weights == pytest.approx(w, abs=1e-6) and found.means == pytest.approx(np.array(mu), abs=1e-6) and found.variances == pytest.approx(np.array(var), abs=1e-6)


def test_sums_share_their_moments_and_one_shuffle(spark, cloud, monkeypatch):
    """A block's moments serve every model, and a pass has one exchange."""
    rng = np.random.default_rng(5)
    some = {k: (mixtures.seeded(cloud, k, rng), k == 3) for k in (2, 3, 4)}
    block = mixtures.moments(cloud)
    for k, (m, hard) in some.items():
        joint = np.array([[math.log(w * density(x, mu, var)) for w, mu, var in zip(m.weights, m.means, m.variances, strict=True)] for x in cloud])
        share = np.exp(joint) / np.exp(joint).sum(1, keepdims=True)
        share = np.eye(k)[joint.argmax(1)] if hard else share
        want = np.concatenate([share.sum(0), (share.T @ cloud).ravel(), (share.T @ cloud**2).ravel(), [np.log(np.exp(joint).sum(1)).sum(), len(cloud)]])
        assert m.log_joint(block) == pytest.approx(joint.T) and m.sums(block, hard) == pytest.approx(want)
    rows = spark.createDataFrame([(x.tolist(),) for x in cloud], "x array<double>").repartition(3).persist()
    plans, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or collect(df))
    got = mixtures.summed(rows, some, "x")
    assert len(plans) == 1 and plans[0].count("Aggregate [") == 1
    assert {k: v.tolist() for k, v in got.items()} == {k: pytest.approx(m.sums(block, hard).tolist()) for k, (m, hard) in some.items()}


def test_components_of_rows_equal_the_densities(spark, cloud):
    rows = [(f"t{k}", dt.date(2020, 1, 1), *map(float, x)) for k, x in enumerate(cloud)] + [("none", dt.date(2020, 1, 1), None, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, a double, b double")
    model = models.RegimeModel(("a", "b"), mixtures.Fitting(components=(2, 3), starts=2)).fit(df)
    x = np.array([r[2:] for r in rows[:-1]])
    low, high = np.quantile(x, 0.01, 0), np.quantile(x, 0.99, 0)
    x = np.clip(x, low, high)
    x = (x - x.mean(0)) / x.std(0)
    m = model.mixture
    got = {r.ticker: r for r in model.transform(df).collect()}
    for k, v in enumerate(x):
        joint = [w * density(v, mu, var) for w, mu, var in zip(m.weights, m.means, m.variances, strict=True)]
        r = got[f"t{k}"]
        assert r.gmm_log_likelihood == pytest.approx(math.log(sum(joint)), abs=1e-6)
        assert [r[f"gmm_regime_prob_{j}"] for j in range(m.k)] == pytest.approx([j / sum(joint) for j in joint], abs=1e-6)
        assert r.gmm_regime_confidence == pytest.approx(max(joint) / sum(joint), abs=1e-6) and joint[int(r.gmm_regime_label)] == max(joint)
    assert all(v is None for c, v in got["none"].asDict().items() if c.startswith("gmm"))
    assert [r.chosen for r in model.scores(spark).orderBy("components").collect()].count(True) == 1


def markov_model(rng, k=3, d=2):
    covariances = np.array([a @ a.T + 0.2 * np.eye(d) for a in rng.normal(0, 0.5, (k, d, d))])
    return markov.Markov(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.normal(0, 2, (k, d)), covariances)


def emission(m, j, x):
    e = x - m.means[j]
    return math.exp(-0.5 * e @ np.linalg.inv(m.covariances[j]) @ e) / math.sqrt((2 * math.pi) ** len(x) * np.linalg.det(m.covariances[j]))


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_blocks_equal_the_sum_over_all_paths(block):
    """Likelihood, probabilities and the likeliest path of six steps, by all 729 paths."""
    rng = np.random.default_rng(block)
    m, x = markov_model(rng), rng.normal(0, 2, (6, 2))
    paths = {}
    for path in itertools.product(range(3), repeat=6):
        p = m.start[path[0]] * emission(m, path[0], x[0])
        for t in range(1, 6):
            p *= m.move[path[t - 1], path[t]] * emission(m, path[t], x[t])
        paths[path] = p
    total = sum(paths.values())
    share, log = markov.posterior(m, x, block)
    assert log == pytest.approx(math.log(total), abs=1e-9)
    for t, j in itertools.product(range(6), range(3)):
        assert share[t, j] == pytest.approx(sum(p for path, p in paths.items() if path[t] == j) / total, abs=1e-9)
    assert tuple(markov.likeliest(m, x)) == max(paths, key=paths.get)


def test_long_series_equal_step_by_step():
    rng = np.random.default_rng(1)
    m, x = markov_model(rng, 4), rng.normal(0, 2, (1000, 2))
    steps, top = m.steps(x)
    v, log = m.start * np.exp(m.log_density(x)[0] - top[0]), top.sum()
    for t in range(1000):
        v = v @ steps[t] if t else v
        log += math.log(v.sum())
        v = v / v.sum()
    share, got = markov.posterior(m, x)
    assert got == pytest.approx(log, abs=1e-6)
    assert share[-1] == pytest.approx(v, abs=1e-9)


def test_fits_find_planted_states():
    rng = np.random.default_rng(3)
    state, states, x = 0, [], []
    for _ in range(900):
        state = state if rng.random() < 0.97 else 1 - state
        states.append(state)
        x.append(rng.normal((-2, 2)[state], 1, 2))
    m = markov.fit(np.array(x), 2)
    got = markov.likeliest(m, np.array(x))
    assert max(np.mean(got == states), np.mean(got != states)) > 0.99
    assert np.diag(m.move) == pytest.approx([0.97, 0.97], abs=0.02) and m.passes < 200


def test_refits_are_tasks_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(k), float(a), float(b) if k % 50 else None) for k, (a, b) in enumerate(rng.normal(0, 1, (200, 2)))]
    df = spark.createDataFrame(rows, "date date, a double, b double")
    got = markov.expanding_regimes(df, ("a", "b"), k=2, least_train=60, every=40).orderBy("date").collect()
    known = [r for r in rows if r[2] is not None]
    assert [r.date for r in got] == [r[0] for r in known]
    ends = [60, 100, 140, 180, 196]
    assert [r.fitted_rows for r in got] == [next(e for e in ends if k < e) for k in range(196)]
    for low, end in zip([0, *ends], ends, strict=False):
        x = np.array([r[1:] for r in known[:end]])
        x = (x - x.mean(0)) / x.std(0)
        m = markov.fit(x, 2)
        share, _ = markov.posterior(m, x[low:])
        assert [r.regime_prob_0 for r in got[low:end]] == pytest.approx(share[:, 0].tolist(), abs=1e-6)
        assert [r.regime_state for r in got[low:end]] == markov.likeliest(m, x[low:]).tolist()
        assert got[low].log_likelihood == pytest.approx(m.log_likelihood, abs=1e-6)
    assert markov.expanding_regimes(df.limit(10), ("a", "b")).count() == 0


def quantile_rows(kind):
    rng = random.Random(kind)
    n = 3000
    return {
        "spread": [rng.lognormvariate(0, 4) * rng.choice([-1, 1]) for _ in range(n)], "ties": [rng.choice([1.0, 1.0, 1.0, 2.0]) for _ in range(n)],
        "few": [3.0, 1.0, None, 2.0], "one": [5.0], "none": [None, None], "huge": [1e300, -1e300, *[1e-300 * k for k in range(500)]],
    }[kind]


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "one", "none", "huge"])
def test_quantiles_equal_sorting(spark, kind):
    """With a limit of ten values, so that brackets are drawn again and again."""
    values = quantile_rows(kind)
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "x double, other int").repartition(3)
    shares = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    known = sorted(v for v in values if v is not None)
    got = exact_quantiles(df, {"x": shares, "other": [0.5]}, most=10, accuracy=50)
    assert got["x"] == (pytest.approx(np.quantile(known, shares).tolist(), rel=1e-12) if known else [None] * 6)
    assert got["other"] == [(len(values) - 1) / 2]
    first = exact_quantiles(df, {"x": shares}, discrete=True, most=10, accuracy=50)["x"]
    assert first == ([known[max(0, math.ceil(q * len(known)) - 1)] for q in shares] if known else [None] * 6)


def test_counts_below(spark):
    rng = random.Random(9)
    rows = sorted({(rng.choice("ab"), rng.choice([0.5, 1.0, rng.random()])) for _ in range(400)})
    df = spark.createDataFrame([(*r, k % 3 + 1) for k, r in enumerate(rows)], "g string, x double, n long")
    data = df.collect()
    for r in counts_below(df, ("g",), "x", "n", bins=7).collect():
        assert r.below == sum(o.n for o in data if o.g == r.g and o.x < r.x)
