"""Constrained programmes: known answers, conditions of the optimum, comparisons with random portfolios."""

import numpy as np
import pytest

from quantloom.functions import kernels as K
from quantloom.functions.programs import augmented_lagrangian, bounded_quadratic, diversified_weights, entropy_slope, nonnegative_ridge


def test_ridge_meets_the_conditions_of_the_optimum():
    rng = np.random.default_rng(1)
    for t in range(40):
        x, y = rng.normal(size=(30, 8)), rng.normal(size=30)
        high = np.inf if t % 2 else 0.1
        w = nonnegative_ridge(x.T @ x, x.T @ y, 0.7, 0.0, high)
        slope = x.T @ (x @ w - y) + 0.49 * w
        assert (w >= 0).all() and (w <= high).all()
        inner = (w > 0) & (w < high)
        assert np.abs(slope[inner]).max(initial=0) < 1e-9 and (slope[w == 0] > -1e-9).all() and (slope[w == high] < 1e-9).all()


def test_ridge_without_penalty_and_bounds_in_play():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=40)
    assert np.allclose(nonnegative_ridge(x.T @ x, x.T @ y, 0.0), K.nonnegative_least_squares(x, y), atol=1e-9)
    assert np.allclose(nonnegative_ridge(x.T @ x, x.T @ y, 2.0, -np.inf), np.linalg.solve(x.T @ x + 4 * np.eye(5), x.T @ y))
    assert np.allclose(bounded_quadratic(np.eye(3), np.array([2.0, -1, 0.5]), 0.0, 1.0), [1, 0, 0.5])


def test_the_known_problem():
    goal = np.array([1.0, 2.5])
    f = lambda x: (((x - goal) ** 2).sum(), 2 * (x - goal))
    rows = np.array([[1.0, -2], [-1, -2], [-1, 2]])
    above = lambda x: (rows @ x + np.array([2.0, 6, 2]), rows)
    assert np.allclose(augmented_lagrangian(f, np.array([2.0, 0]), None, above, low=0.0), [1.4, 1.7], atol=1e-6)
    line = np.array([[1.7, 0.6]])
    assert np.allclose(augmented_lagrangian(f, np.array([2.0, 0]), lambda x: (line @ x - 3.4, line), above, low=0.0), [1.4, 1.7], atol=1e-6)


def test_constraints_that_cannot_be_met():
    f = lambda x: (x @ x, 2 * x)
    two = np.array([[1.0, 1], [1, 1]])
    with pytest.raises(ArithmeticError):
        augmented_lagrangian(f, np.zeros(2), lambda x: (two @ x - np.array([1.0, 2]), two), low=0.0)


def covariance(seed, n=6):
    x = np.random.default_rng(seed).normal(size=(80, n)) @ np.random.default_rng(seed + 50).normal(size=(n, n))
    return np.cov(x.T)


def test_slope_of_the_entropy():
    rng = np.random.default_rng(3)
    f, w = entropy_slope(rng.normal(size=(4, 5)), rng.normal(size=(4, 5))), rng.random(5)
    for i in range(5):
        step = 1e-6 * np.eye(5)[i]
        assert abs((f(w + step)[0] - f(w - step)[0]) / 2e-6 - f(w)[1][i]) < 1e-5


def test_even_risk_on_a_diagonal():
    cov = np.diag([1.0, 4, 9, 16])
    w, bets = diversified_weights(cov)
    assert np.allclose(w, (1 / np.sqrt(np.diag(cov))) / (1 / np.sqrt(np.diag(cov))).sum(), atol=1e-4) and abs(bets - 4) < 1e-6


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("factors", [False, True])
def test_no_random_portfolio_is_spread_better(seed, factors):
    cov, rng = covariance(seed), np.random.default_rng(seed)
    loadings = np.abs(rng.normal(size=(6, 2))) if factors else None
    w, bets = diversified_weights(cov, loadings)
    assert (w >= 0).all() and abs(w.sum() - 1) < 1e-9

    def spread(w):
        if not factors:
            value, vector = np.linalg.eigh(cov)
            p = (vector.T @ w) ** 2 * value
        else:
            rest = np.linalg.svd(loadings)[0][:, 2:]
            p = np.abs(np.append((loadings.T @ w) * (np.linalg.pinv(loadings) @ cov @ w), (rest.T @ w) * (rest.T @ cov @ w)))
        p = p[p > 0] / p.sum()
        return np.exp(-(p * np.log(p)).sum())

    assert abs(spread(w) - bets) < 1e-4
    assert max(spread(v) for v in rng.dirichlet(np.full(6, 0.7), size=4000)) < bets + 1e-3


def test_no_part_in_small_components():
    block = np.array([[1.0, 0.8], [0.8, 1.0]])
    cov = np.kron(np.diag([1.0, 4.0]), block)
    w, bets = diversified_weights(cov, components=2)
    assert np.allclose(w[0], w[1]) and np.allclose(w[2], w[3]) and abs(bets - 2) < 1e-4
    assert np.allclose(w, np.array([2, 2, 1, 1]) / 6, atol=1e-3)


def test_tracking_by_fold_equals_the_same_fit_on_matrices(spark):
    from quantloom.operators.budgets import tracking, tracking_quality

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)) * 0.05 + 0.01
    y = x @ np.array([0.6, 0.0, 0.3, 0.1]) + rng.normal(size=60) * 0.004 + 0.02
    rows = [(0, "train" if t < 40 else "test", f"a{j}", t, float(x[t, j])) for t in range(60) for j in range(4)]
    split = spark.createDataFrame(rows, "cv int, split string, asset string, dt int, r double")
    target = spark.createDataFrame([(t, float(y[t])) for t in range(60)], "dt int, y double")
    got = tracking(split, target, 0.05)
    coef = np.array([r["coef"] for r in got.orderBy("asset").collect()])
    u, v = x[:40] - x[:40].mean(0), y[:40] - y[:40].mean()
    assert np.allclose(coef, nonnegative_ridge(u.T @ u, u.T @ v, 0.05), atol=1e-9) and (coef >= 0).all()
    quality = {r["split"]: r for r in tracking_quality(split, target, got).collect()}
    for name, part in (("train", slice(0, 40)), ("test", slice(40, 60))):
        assert np.isclose(quality[name]["r2"], 1 - (y[part] - x[part] @ coef).var() / y[part].var()) and quality[name]["n"] == part.stop - part.start


def test_diversified_by_fold(spark):
    from quantloom.operators.budgets import diversified

    cov, names = covariance(2, 4), ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(0, names[i], names[j], float(cov[i, j])) for i in range(4) for j in range(4)], "cv int, a string, b string, cov double")
    loads = np.abs(np.random.default_rng(9).normal(size=(4, 2)))
    loadings = spark.createDataFrame([(names[i], k, float(loads[i, k])) for i in range(4) for k in range(2)], "asset string, factor int, loading double")
    got = {(r["strategy"], r["asset"]): (r["w"], r["bets"]) for r in diversified(rows, loadings).collect()}
    for strategy, own in (("drp", None), ("drp_factor", loads)):
        w, bets = diversified_weights(cov, own)
        assert np.allclose([got[strategy, n][0] for n in names], w, atol=1e-6) and np.isclose(got[strategy, "a"][1], bets, atol=1e-6)
