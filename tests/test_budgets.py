"""Scenario risk budgets and the critical line: closed forms, conditions of the optimum, other ways to the same answer."""

import numpy as np
import pytest

from quantloom.functions import kernels as K
from quantloom.functions.budgets import drawdown_at_risk, drawdowns, mean_of_worst, scenario_budget, shortfall
from quantloom.functions.critical_line import critical_line, largest_sharpe
from quantloom.operators.budgets import scenario_weights


def scenarios(seed=1, dates=180, n=6):
    return np.random.default_rng(seed).standard_t(4, size=(dates, n)) * np.linspace(0.5, 3, n) * 0.01 + 0.0003


def test_measures():
    assert mean_of_worst(np.array([5.0, 1, 4, 2]), 0.5) == 4.5 and abs(mean_of_worst(np.array([5.0, 1, 4, 2]), 0.375) - (5 + 0.5 * 4) / 1.5) < 1e-12
    assert np.allclose(drawdowns(np.array([0.1, -0.2, 0.05, 0.3, -0.1])), [0, 0.2, 0.15, 0, 0.1])
    assert np.allclose(drawdowns(np.array([-0.1, 0.05])), [0.1, 0.05])


@pytest.mark.parametrize("drawdown", [False, True])
@pytest.mark.parametrize("even", [False, True])
def test_budgets_are_met_at_an_optimum(drawdown, even):
    r = scenarios()
    b = np.full(6, 1 / 6) if even else np.arange(1, 7) / 21
    w, shares = scenario_budget(r, None if even else b, drawdown=drawdown)
    assert abs(w.sum() - 1) < 1e-12 and (w > 0).all() and np.abs(shares - b).max() < 1e-4
    measure = lambda v: (drawdown_at_risk if drawdown else shortfall)(r @ v)
    w = w / measure(w)
    f, rng = lambda v: measure(v) - b @ np.log(v), np.random.default_rng(3)
    assert all(f(w * np.exp(rng.normal(size=6) * e)) >= f(w) - 1e-6 for e in (0.3, 0.1, 0.01, 1e-3) for _ in range(100))


@pytest.mark.parametrize("drawdown", [False, True])
def test_assets_that_move_together_get_weights_inverse_to_their_scale(drawdown):
    x = np.random.default_rng(2).standard_normal(150) - 0.2
    assert np.allclose(scenario_budget(np.outer(x, [1.0, 2, 4]), drawdown=drawdown)[0], np.array([4, 2, 1]) / 7, atol=1e-6)
    b = np.array([0.5, 0.3, 0.2])
    assert np.allclose(scenario_budget(np.outer(x, [1.0, 2, 4]), b, drawdown=drawdown)[0], (b / [1, 2, 4]) / (b / [1, 2, 4]).sum(), atol=1e-6)


def test_no_budget_without_losses():
    r = scenarios()
    r[:, 0] = np.abs(r[:, 0]) + 0.01
    with pytest.raises((ArithmeticError, np.linalg.LinAlgError)):
        scenario_budget(r)


def test_scenario_weights_by_fold(spark):
    r, names = scenarios(4, 60, 4), ["a", "b", "c", "d"]
    rows = [(0, "train", n, f"2000-{1 + t // 28:02d}-{1 + t % 28:02d}", float(r[t, j])) for t in range(60) for j, n in enumerate(names)]
    split = spark.createDataFrame(rows, "cv int, split string, asset string, d string, r double").selectExpr("cv", "split", "asset", "to_date(d) AS dt", "r")
    labels = spark.createDataFrame([("a", 0, 0.8), ("b", 0, 0.6), ("c", 1, 1.0)], "asset string, factor int, loading double")
    got = {(x["strategy"], x["asset"]): (x["w"], x["share"]) for x in scenario_weights(split, labels, window=50, alpha=0.1).collect()}
    assert len(got) == 5 * 4
    for strategy, drawdown in (("erc_es", False), ("erc_cdar", True)):
        want = scenario_budget(r[-50:], None, 0.1, drawdown)[0]
        assert np.allclose([got[strategy, n][0] for n in names], want, atol=1e-6)
        assert np.allclose([got[strategy, n][1] for n in names], 0.25, atol=1e-4)
    for strategy, drawdown in (("factor_full_es", False), ("factor_full_cdar", True)):
        inner = scenario_budget(r[-50:, :2], np.array([0.64, 0.36]), 0.1, drawdown)[0]
        outer = scenario_budget(np.column_stack([r[-50:, :2] @ inner, r[-50:, 2]]), None, 0.1, drawdown)[0]
        assert np.allclose([got[strategy, n][0] for n in names], [*(inner * outer[0]), outer[1], 0], atol=1e-6)
    cov = np.cov(r[-50:].T)
    assert np.isclose(got["factor_full_vol", "d"][0], 0) and got["factor_full_vol", "c"][0] > 0 and cov.shape == (4, 4)


def problem(seed, n=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, n)) @ rng.normal(size=(n, n))
    return rng.normal(size=n) * 0.1 + 0.2, np.cov(x.T)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("high", [1.0, 0.3])
def test_corners_meet_the_conditions_of_the_optimum(seed, high):
    mean, cov = problem(seed)
    slopes, corners = critical_line(mean, cov, 0.0, high)
    assert slopes[0] == np.inf and slopes[-1] == 0 and (np.diff(slopes[1:]) <= 1e-9).all()
    assert np.allclose(corners.sum(1), 1) and (corners > -1e-12).all() and (corners < high + 1e-12).all()
    for i in range(1, len(slopes)):
        for t in (0.0, 0.4):  # at corners and between them
            j = min(i + 1, len(slopes) - 1)
            s, w = (1 - t) * slopes[i] + t * slopes[j], (1 - t) * corners[i] + t * corners[j]
            g = cov @ w - s * mean
            inner = (w > 1e-9) & (w < high - 1e-9)
            level = g[inner].mean() if inner.any() else (g[w >= high - 1e-9].max() + g[w <= 1e-9].min()) / 2
            scale = 1e-7 * (np.abs(g).max() + 1)
            assert (np.abs(g[inner] - level) < scale).all() and (g[w <= 1e-9] > level - scale).all() and (g[w >= high - 1e-9] < level + scale).all()


def test_ends_and_two_assets():
    mean, cov = np.array([0.1, 0.2]), np.array([[0.04, 0.006], [0.006, 0.09]])
    slopes, corners = critical_line(mean, cov)
    v = (0.09 - 0.006) / (0.04 + 0.09 - 0.012)
    assert np.allclose(corners[0], [0, 1]) and np.allclose(corners[-1], [v, 1 - v])
    best, ratio = largest_sharpe(mean, cov, corners)
    tangency = np.linalg.solve(cov, mean)
    assert np.allclose(best, tangency / tangency.sum()) and np.isclose(ratio, np.sqrt(mean @ np.linalg.solve(cov, mean)))


def test_frontier_between_corners_equals_the_other_solver():
    mean, cov = problem(3)
    slopes, corners = critical_line(mean, cov)
    targets, weights = K.efficient_frontier(mean, cov, 7)
    means = corners @ mean
    for t, w in zip(targets[1:-1], weights[1:-1], strict=True):
        i = np.flatnonzero((means[:-1] >= t) & (means[1:] <= t))[0]
        part = (means[i] - t) / (means[i] - means[i + 1])
        assert np.allclose(corners[i] + part * (corners[i + 1] - corners[i]), w, atol=1e-4)


def test_equal_means_and_bounds_without_answer():
    slopes, corners = critical_line(np.full(4, 0.1), np.diag([1.0, 2, 3, 4]))
    want = 1 / np.array([1.0, 2, 3, 4])
    assert np.allclose(corners[-1], want / want.sum(), atol=1e-6)
    with pytest.raises(ValueError):
        critical_line(np.ones(3), np.eye(3), 0.0, 0.2)
