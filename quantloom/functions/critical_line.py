"""The mean-variance frontier between bounds as a chain of corner portfolios (Markowitz's critical line); numpy only."""

from __future__ import annotations

import numpy as np


def _richest(mean: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, int]:
    """The portfolio of the largest mean between the bounds, and the asset on which the budget ran out."""
    w, left = low.copy(), 1 - low.sum()
    for i in np.argsort(-mean, kind="stable"):
        add = min(left, high[i] - low[i])
        w[i] += add
        left -= add
        if left <= 1e-15:
            return w, int(i)
    raise ValueError("the upper bounds leave part of the budget")


def critical_line(mean: np.ndarray, cov: np.ndarray, low: np.ndarray | float = 0.0, high: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, weights): the corner portfolios from the largest mean to the least variance, a row each.

    For a slope s the portfolio has the least half variance less s times the mean, with weights between the bounds
    that sum to one. Between two corners the same assets lie on bounds, and the others move on a line with s. From s
    without bound down to 0 the next corner is where a free asset meets a bound or the gain from moving one on a
    bound comes to zero. The covariance must be positive definite; equal means are told apart by a millionth part
    of a millionth of their size, so that the chain begins at one portfolio."""
    n = len(mean)
    low, high = np.broadcast_to(low, n).astype(float), np.broadcast_to(high, n).astype(float)
    if low.sum() > 1 + 1e-12 or (low > high).any():
        raise ValueError("the lower bounds exceed the budget or the upper bounds")
    scale = max(np.abs(mean).max(), 1e-300)
    m = mean + 1e-12 * scale * np.arange(n)[::-1]
    w, moving = _richest(m, low, high)
    free = np.zeros(n, bool)
    free[moving] = True
    slopes, corners, slope, moved = [np.inf], [w.copy()], np.inf, -1
    for _ in range(50 * n + 50):
        f, b = np.flatnonzero(free), np.flatnonzero(~free)
        system = np.block([[cov[np.ix_(f, f)], np.ones((len(f), 1))], [np.ones((1, len(f))), np.zeros((1, 1))]])
        right = np.column_stack([np.append(-cov[np.ix_(f, b)] @ w[b], 1 - w[b].sum()), np.append(m[f], 0.0)])
        fixed, grown = np.linalg.solve(system, right).T
        base, lift = w.copy(), np.zeros(n)
        base[f], lift[f] = fixed[:-1], grown[:-1]
        # Derivative of the objective by each weight on a bound, constant part and part that grows with the slope.
        still, rate = cov @ base + fixed[-1], cov @ lift - m + grown[-1]
        best, change = 0.0, (-1, 0.0)
        for i in f:
            if len(f) > 1 and lift[i] != 0:
                bound = low[i] if lift[i] > 0 else high[i]
                at = (bound - base[i]) / lift[i]
                if best < at <= slope * (1 + 1e-10) and i != moved:
                    best, change = at, (i, bound)
        for i in b:
            if rate[i] != 0 and i != moved and high[i] > low[i]:
                at = -still[i] / rate[i]
                closing = rate[i] < 0 if w[i] == high[i] else rate[i] > 0  # falls to zero as the slope does
                if closing and best < at <= slope * (1 + 1e-10):
                    best, change = at, (i, np.nan)
        slope = best
        w = np.clip(base + slope * lift, low, high)
        slopes.append(slope)
        corners.append(w.copy())
        if change[0] < 0:
            return np.array(slopes), np.array(corners)
        moved, bound = change
        free[moved] = np.isnan(bound)
        if not free[moved]:
            w[moved] = bound
    raise ArithmeticError("the critical line did not end")


def largest_sharpe(mean: np.ndarray, cov: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, ratio): the largest mean to deviation on the frontier. On the line between two corners the ratio has one
    peak, where its derivative's one root lies."""
    best, found = -np.inf, corners[0]
    for a, b in zip(corners, np.vstack([corners[1:], corners[-1:]]), strict=True):
        d = b - a
        m0, m1, c0, c1, c2 = mean @ a, mean @ d, a @ cov @ a, a @ cov @ d, d @ cov @ d
        turn = m1 * c1 - m0 * c2
        for t in {0.0, 1.0, min(1.0, max(0.0, (m0 * c1 - m1 * c0) / turn)) if turn else 0.0}:
            w = a + t * d
            ratio = mean @ w / np.sqrt(w @ cov @ w)
            if ratio > best:
                best, found = ratio, w
    return found, float(best)
