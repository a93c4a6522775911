"""Risk budgets on scenario measures: expected shortfall and conditional drawdown at risk; numpy only."""

from __future__ import annotations

import numpy as np


def mean_of_worst(losses: np.ndarray, alpha: float) -> float:
    """Mean of the worst share ``alpha`` of the losses, of which the last counts in part."""
    worst = np.sort(losses)[::-1]
    weight = np.clip(alpha * len(worst) - np.arange(len(worst)), 0, 1)
    return float(worst @ weight / weight.sum())


def drawdowns(r: np.ndarray) -> np.ndarray:
    """How far the running sum of returns lies below its peak, the start included."""
    path = np.concatenate([[0.0], np.cumsum(r)])
    return (np.maximum.accumulate(path) - path)[1:]


def shortfall(r: np.ndarray, alpha: float = 0.05) -> float:
    return mean_of_worst(-r, alpha)


def drawdown_at_risk(r: np.ndarray, alpha: float = 0.05) -> float:
    return mean_of_worst(drawdowns(r), alpha)


def _barrier(rows: np.ndarray, cost: np.ndarray, budget: np.ndarray, start: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(x, multipliers): the minimum of cost.x less the budgets' weighted logarithms of the first values of x, where all
    rows.x are above zero, by Newton steps with a barrier that is drawn in. ``start`` lies inside."""
    x, n, mu = start.copy(), len(budget), 1.0

    def value(x: np.ndarray, slack: np.ndarray, mu: float) -> float:
        return cost @ x - budget @ np.log(x[:n]) - mu * np.log(slack).sum()

    while True:
        for _ in range(60):
            slack = rows @ x
            slope = cost - mu * (1 / slack) @ rows
            slope[:n] -= budget / x[:n]
            bend = (rows * (mu / slack**2)[:, None]).T @ rows
            bend[np.arange(n), np.arange(n)] += budget / x[:n] ** 2
            step = np.linalg.solve(bend + 1e-14 * np.trace(bend) / len(bend) * np.eye(len(bend)), -slope)
            gain = -slope @ step
            if not gain > 1e-9 * mu:
                break
            size, now = 1.0, value(x, slack, mu)
            while size > 1e-14:
                new = x + size * step
                inside = rows @ new
                if (new[:n] > 0).all() and (inside > 0).all() and value(new, inside, mu) <= now - 0.01 * size * gain:
                    break
                size /= 2
            else:
                break
            x = new
        if mu * len(rows) < tol:
            return x, mu / (rows @ x)
        mu /= 8


def scenario_budget(r: np.ndarray, budget: np.ndarray | None = None, alpha: float = 0.05, drawdown: bool = False, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, shares): long-only weights whose shares of the expected shortfall of the returns ``r`` (a row each date),
    or of the mean of the worst drawdowns, equal ``budget`` (even if None), and the shares found.

    The measure is a maximum of linear functions of the weights, so it is the least value of a linear programme: a
    threshold plus the mean excess over it of each date's loss or drawdown. That programme less the budgets' weighted
    logarithms is convex; at its minimum weight times slope of the measure is the budget. The slope comes from the
    multipliers, which weigh the dates. Raises where some portfolio has no loss at all, as budgets have no answer then.
    """
    dates, n = r.shape
    b = np.full(n, 1 / n) if budget is None else np.asarray(budget, float) / np.sum(budget)
    unit = np.abs(r).mean() or 1.0
    r = r / unit
    eye, none = np.eye(dates), np.zeros((dates, dates))
    column = lambda v: np.full((dates, 1), v)
    if drawdown:  # weights, threshold, excess and drawdown of each date
        later = eye - np.eye(dates, k=-1)
        rows = [np.hstack([np.zeros((dates, n)), column(1.0), eye, -eye]), np.hstack([r, column(0.0), none, later]), np.hstack([np.zeros((dates, n + 1)), none, eye])]
        rows.append(np.hstack([np.zeros((dates, n + 1)), eye, none]))
    else:
        rows = [np.hstack([r, column(1.0), eye]), np.hstack([np.zeros((dates, n + 1)), eye])]
    rows = np.vstack(rows)
    cost = np.zeros(rows.shape[1])
    cost[n], cost[n + 1 : n + 1 + dates] = 1.0, 1 / (alpha * dates)
    w = b / np.maximum(np.abs(r).mean(0), 1e-9)
    own = r @ w
    fall = np.concatenate([[0.0], np.cumsum(np.abs(own) + 1)])[1:]
    start = np.concatenate([w, [0.0], fall + 1, fall] if drawdown else [w, [0.0], np.maximum(-own, 0) + 1])
    x, multipliers = _barrier(rows, cost, b, start, tol)
    w = x[:n]
    measure = (drawdown_at_risk if drawdown else shortfall)(r @ w, alpha)
    if not np.isfinite(w).all() or measure < 1e-6 or w.max() > 1e8:
        raise ArithmeticError("there is a portfolio without losses, so that risk budgets have no answer")
    # A drawdown's slope carries the returns since the peak: the chain of its constraints passes multipliers on.
    weights = multipliers[dates : 2 * dates] if drawdown else multipliers[:dates]
    return w / w.sum(), w * -(weights @ r) / measure
