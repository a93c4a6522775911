"""Models of the next return: laws against numbers worked out otherwise, fits against simulated series, no look-ahead."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import stats
from quantloom.functions.volatility import Models, Spec, cdf, fit, incomplete_beta, log_density, minimise, pareto_tails, student_cdf
from quantloom.operators import volatility


def simulated(n, seed, law="norm", mu=0.1, ar=0.5, ma=0.0, omega=0.1, alpha=0.15, beta=0.75):
    rng = np.random.default_rng(seed)
    z = rng.standard_normal(n) if law == "norm" else rng.standard_t(6, n) * np.sqrt(4 / 6)
    x, e, h = np.zeros(n), np.zeros(n), np.full(n, omega / (1 - alpha - beta))
    for t in range(1, n):
        h[t] = omega + alpha * e[t - 1] ** 2 + beta * h[t - 1]
        e[t] = np.sqrt(h[t]) * z[t]
        x[t] = mu + ar * x[t - 1] + ma * e[t - 1] + e[t]
    return x


@pytest.mark.parametrize("law", [{}, {"shape": 5.0}, {"skew": 1.7}, {"skew": 0.6, "shape": 7.0}])
def test_laws_have_mean_zero_and_variance_one_and_the_cdf_of_their_density(law):
    law = {k: np.array(v) for k, v in law.items()}
    x = np.linspace(-60, 60, 600_001)
    f, dx = np.exp(log_density(x, **law)), x[1] - x[0]
    assert abs(f.sum() * dx - 1) < 1e-6 and abs((x * f).sum() * dx) < 1e-5 and abs((x * x * f).sum() * dx - 1) < 1e-3
    at = slice(290_000, 310_001, 500)
    assert np.abs((np.cumsum(f) - f / 2)[at] * dx - cdf(x[at], **law)).max() < 1e-6


def test_student_and_beta_against_closed_forms():
    x = np.linspace(-4, 4, 33)
    t = x * np.sqrt(4 / 2)  # four degrees of freedom
    want = 0.5 + 3 / 8 * (t / np.sqrt(1 + t * t / 4)) * (1 - t * t / (1 + t * t / 4) / 12)
    assert np.allclose(student_cdf(x, np.full(33, 4.0)), want, atol=1e-12)
    assert math.isclose(incomplete_beta(np.array([0.3]), np.array([2.0]), np.array([3.0]))[0], 0.3483, abs_tol=1e-12)


def test_minima_of_many_functions():
    goal = np.random.default_rng(1).normal(size=(50, 4))
    f = lambda x, row: ((x - goal[row]) ** 4).sum(1) + ((x[:, :3] - goal[row, :3]) * (x[:, 1:] - goal[row, 1:])).sum(1) ** 2
    x, value = minimise(f, np.zeros((50, 4)), rounds=400, tol=1e-14)
    assert value.max() < 1e-6


def test_simulated_parameters_are_found_again():
    found = fit([simulated(6000, 1), simulated(5000, 2, "std", ar=-0.4)], [Spec(1, 0, 1, 1, "norm"), Spec(1, 0, 1, 1, "std")])
    assert np.allclose(found.at["ar"][:, 0], [0.5, -0.4], atol=0.05)
    assert np.allclose(found.at["alpha"][:, 0], 0.15, atol=0.05) and np.allclose(found.at["beta"][:, 0], 0.75, atol=0.08)
    assert abs(found.at["shape"][1] - 6) < 1.5
    moving = fit([simulated(6000, 3, ar=0.0, ma=0.6)], [Spec(0, 1, 0, 0)])
    assert abs(moving.at["ma"][0, 0] - 0.6) < 0.05
    bent = np.random.default_rng(5).gamma(2.0, size=4000)
    assert fit([bent], [Spec(0, 0, 0, 0, "snorm")]).at["skew"][0] > 1.5


def test_forecast_and_chance_follow_from_the_fitted_recursion():
    x = simulated(400, 7)
    found = fit([x], [Spec(1, 1, 1, 1)])
    at = {k: v[0] for k, v in found.at.items()}
    u, e, h = x / x.std(ddof=1), np.zeros(400), np.full(401, (x / x.std(ddof=1)).var())
    for t in range(2, 401):
        h[t] = at["omega"] + at["alpha"][0] * (e[t - 1] ** 2 if t > 2 else h[0]) + at["beta"][0] * h[t - 1]
        mean = at["mu"] + at["ar"][0] * u[t - 1] + at["ma"][0] * e[t - 1]
        if t < 400:
            e[t] = u[t] - mean
    assert math.isclose(found.sd[0], math.sqrt(h[400]) * x.std(ddof=1), rel_tol=1e-9)
    assert math.isclose(found.mean[0], mean * x.std(ddof=1), rel_tol=1e-9)
    assert math.isclose(found.chance[0], 0.5 * math.erfc(mean / math.sqrt(h[400]) / math.sqrt(2)), rel_tol=1e-9)
    loss = -sum(-0.5 * (math.log(2 * math.pi * v) + a * a / v) for a, v in zip(e[2:], h[2:400], strict=True))
    assert math.isclose(found.aic[0], (2 * loss + 2 * 6) / 398, rel_tol=1e-9)


def test_series_of_other_lengths_do_not_matter():
    a, b = simulated(90, 1), simulated(60, 2)
    both, alone = fit([a, b], [Spec(1, 0, 1, 1, "std")] * 2), fit([b], [Spec(1, 0, 1, 1, "std")])
    assert math.isclose(both.aic[1], alone.aic[0], rel_tol=1e-6) and math.isclose(both.chance[1], alone.chance[0], rel_tol=1e-3)


def test_no_fit_without_values():
    found = fit([np.zeros(50), np.array([1.0, 2.0]), np.array([]), np.array([np.nan] * 50), simulated(50, 1)], [Spec()] * 5)
    assert np.isinf(found.aic[:4]).all() and np.isnan(found.chance[:4]).all() and np.isfinite(found.aic[4])


def test_unused_numbers_do_not_matter():
    models = Models([Spec(0, 1, 1, 0, "std")])
    x, z = simulated(50, 4)[None], np.full((1, 12), 0.3)
    other = np.where(models.used, z, 9.0)
    assert models.losses(x, np.array([2]), z) == models.losses(x, np.array([2]), other)


def test_pareto_tail_is_found_again():
    rng = np.random.default_rng(3)
    excess = 2.0 * (rng.random((1, 20_000)) ** -0.25 - 1) / 0.25
    shape, scale = pareto_tails(excess, np.zeros(1))
    assert abs(shape[0] - 0.25) < 0.03 and abs(scale[0] - 2) < 0.1
    assert np.isnan(pareto_tails(np.array([[1.0, -1.0]]), np.zeros(1))[0][0])


def test_joined_exceedance_meets_at_the_threshold(spark):
    rows = [(z, 1.0, k, 0.5) for z in (-2.0, 0.999999, 1.0, 1.5, 2.9, 4.0) for k in (0.3, 0.0, -0.25)] + [(0.0, 1.0, None, 0.5)]
    got = spark.createDataFrame(rows, "z double, u double, k double, s double")
    got = got.withColumn("p", stats.joined_exceedance(F.col("z"), F.col("u"), F.col("k"), F.col("s"))).collect()
    above = 0.5 * math.erfc(1 / math.sqrt(2))
    for r in got:
        if r["k"] is None:
            assert r["p"] is None
        elif r["z"] < 1:
            assert math.isclose(r["p"], 0.5 * math.erfc(r["z"] / math.sqrt(2)), abs_tol=1e-6)
        else:
            e = (r["z"] - 1) / r["s"]
            tail = math.exp(-e) if r["k"] == 0 else max(0, 1 + r["k"] * e) ** (-1 / r["k"])
            assert math.isclose(r["p"], above * tail, abs_tol=1e-6)


def test_later_returns_change_nothing_before(spark):
    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(70)]
    x = simulated(70, 11) / 50
    rows = [(k, d, float(v)) for k in ("a", "b") for d, v in zip(days, x if k == "a" else -x, strict=True)]
    other = [(k, d, v if d < days[55] else v * 7 + 1) for k, d, v in rows]
    folds = spark.createDataFrame([(0, days[45], days[60])], "cv int, test_start date, end date")
    run = lambda r: {(x["factor"], x["dt"]): x["chance"] for x in volatility.model_chances(spark.createDataFrame(r, "factor string, dt date, r double"), folds, window=40, laws=("norm",), ps=(1,), qs=(0, 1)).collect()}
    one, two = run(rows), run(other)
    assert len(one) == 2 * 15
    same = {k for k in one if k[1] <= days[55]}
    assert all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in same)
    assert any(abs(one[k] - two[k]) > 1e-3 for k in set(one) - same)


def test_a_series_without_movement_has_no_model(spark):
    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(40)]
    folds = spark.createDataFrame([(0, days[30], days[39])], "cv int, test_start date, end date")
    flat = spark.createDataFrame([("a", d, 0.0) for d in days], "factor string, dt date, r double")
    assert volatility.model_chances(flat, folds, laws=("norm",), ps=(1,), qs=(0,)).count() == 0
