"""Small constrained programmes: quadratic ones between bounds, and smooth ones by an augmented Lagrangian; numpy only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A function's value and slope, or values of several and a row of slopes for each.
Smooth = Callable[[np.ndarray], tuple]


def bounded_quadratic(q: np.ndarray, c: np.ndarray, low: np.ndarray | float = 0.0, high: np.ndarray | float = np.inf, rounds: int = 1000) -> np.ndarray:
    """The x between bounds with the least x.q.x / 2 - c.x, by projected Newton steps: coordinates on a bound that the
    slope pushes out of it stay, the others move to their own minimum as far as the bounds let them. ``q`` must be
    positive definite. Raises if the steps do not settle."""
    n = len(c)
    low, high = np.broadcast_to(low, n).astype(float), np.broadcast_to(high, n).astype(float)
    x = np.clip(np.zeros(n), low, high)
    value = lambda x: 0.5 * x @ q @ x - c @ x
    scale = max(np.abs(c).max(initial=0), np.abs(q).max(initial=0), 1e-300)
    for _ in range(rounds):
        slope = q @ x - c
        held = ((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0))
        free = np.flatnonzero(~held)
        if not len(free) or np.abs(slope[free]).max() < 1e-12 * scale:
            return x
        step = np.zeros(n)
        step[free] = -np.linalg.solve(q[np.ix_(free, free)], slope[free])
        size, now = 1.0, value(x)
        while size > 1e-12 and value(np.clip(x + size * step, low, high)) > now - 1e-4 * slope @ (x - np.clip(x + size * step, low, high)):
            size /= 2
        new = np.clip(x + size * step, low, high)
        if np.array_equal(new, x):
            return x
        x = new
    raise ArithmeticError(f"the bounded quadratic programme did not settle in {rounds} rounds")


def nonnegative_ridge(gram: np.ndarray, products: np.ndarray, penalty: float, low: np.ndarray | float = 0.0, high: np.ndarray | float = np.inf) -> np.ndarray:
    """Coefficients between bounds with the least sum of squared errors plus penalty squared times their own squares, from
    sums of products of the regressors with each other and with the target."""
    return bounded_quadratic(gram + penalty**2 * np.eye(len(gram)), products, low, high)


def _projected(f: Smooth, x: np.ndarray, low: np.ndarray, high: np.ndarray, tol: float, rounds: int = 300) -> np.ndarray:
    """A minimum of ``f`` between bounds by projected quasi-Newton steps."""
    bend, (value, slope) = np.eye(len(x)), f(x)
    for _ in range(rounds):
        held = ((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0))
        free = np.flatnonzero(~held)
        if not len(free) or np.abs(slope[free]).max() < tol:
            break
        step = np.zeros(len(x))
        step[free] = -np.linalg.solve(bend[np.ix_(free, free)], slope[free])
        if step @ slope >= 0:
            step[free], bend = -slope[free], np.eye(len(x))
        size = 1.0
        while size > 1e-14:
            new = np.clip(x + size * step, low, high)
            after = f(new)
            if after[0] <= value + 1e-4 * slope @ (new - x):
                break
            size /= 2
        else:
            break
        s, y = new - x, after[1] - slope
        sbs = s @ bend @ s
        if sbs > 0:
            part = 1.0 if s @ y >= 0.2 * sbs else 0.8 * sbs / (sbs - s @ y)  # keeps the matrix positive (Powell 1978)
            y = part * y + (1 - part) * (bend @ s)
            bend = bend + np.outer(y, y) / (s @ y) - np.outer(bend @ s, bend @ s) / sbs
        x, (value, slope) = new, after
        if np.abs(s).max() < 1e-14:
            break
    return x


def augmented_lagrangian(f: Smooth, start: np.ndarray, equal: Smooth | None = None, above: Smooth | None = None, low: np.ndarray | float = -np.inf, high: np.ndarray | float = np.inf, tol: float = 1e-8, rounds: int = 60) -> np.ndarray:
    """A minimum of ``f`` where all ``equal`` are zero, all ``above`` not below zero, and x is between bounds. Each round
    minimises f with multipliers and squares of what is violated between the bounds, then moves the multipliers by
    the violation, and weighs squares more where that did not fall to a quarter. Raises if constraints stay violated."""
    n = len(start)
    low, high = np.broadcast_to(low, n).astype(float), np.broadcast_to(high, n).astype(float)
    none = (np.zeros(0), np.zeros((0, n)))
    equal, above = equal or (lambda x: none), above or (lambda x: none)
    x = np.clip(start.astype(float), low, high)
    one, two, weight, worst = np.zeros(len(equal(x)[0])), np.zeros(len(above(x)[0])), 10.0, np.inf

    def penalised(x: np.ndarray) -> tuple[float, np.ndarray]:
        (v, g), (e, je), (h, jh) = f(x), equal(x), above(x)
        push = np.maximum(0, two - weight * h)
        slope = g - je.T @ (one - weight * e) - jh.T @ push
        return v - one @ e + weight / 2 * e @ e + (push @ push - two @ two) / (2 * weight), slope

    for _ in range(rounds):
        x = _projected(penalised, x, low, high, tol)
        e, h = equal(x)[0], above(x)[0]
        off = max(np.abs(e).max(initial=0), np.abs(np.minimum(h, two / weight)).max(initial=0))
        if off < tol:
            return x
        one, two = one - weight * e, np.maximum(0, two - weight * h)
        if off > worst / 4:
            weight = min(weight * 5, 1e9)
        worst = min(off, worst)
    if max(np.abs(e).max(initial=0), -h.min(initial=0)) > 1e-5:
        raise ArithmeticError("the constraints cannot be met")
    return x


def entropy_slope(left: np.ndarray, right: np.ndarray) -> Smooth:
    """Minus the entropy of the shares of |(left w) (right w)|, and its slope by w: the rows' products are risks of
    sources that the portfolio w is made of. A share of zero adds nothing."""

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        a, b = left @ w, right @ w
        risk = np.abs(a * b)
        total = max(risk.sum(), 1e-300)
        p = np.maximum(risk / total, 1e-14)
        level = np.log(p) + 1
        pull = np.sign(a * b) * (level - (risk / total) @ level) / total
        return float((p * np.log(p)).sum()), left.T @ (pull * b) + right.T @ (pull * a)

    return f


def diversified_weights(cov: np.ndarray, loadings: np.ndarray | None = None, components: int | None = None) -> tuple[np.ndarray, float]:
    """(weights, bets): fully invested long-only weights whose risk is spread most evenly, by entropy, over the principal
    portfolios of ``cov``, or over the factors with ``loadings`` (a column each) and what lies outside them; and the
    exponential of the entropy. With ``components`` the portfolio has no part in smaller principal portfolios. The
    problem has several optima; the best from an even start, one inverse to the deviations and one by the assets'
    shares in the largest component is taken."""
    n, (value, vector) = len(cov), np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    scale = 1 / np.trace(cov) * n
    if loadings is None:
        left, right = vector.T, (vector * np.maximum(value, 0)).T * scale
    else:
        u, s, _ = np.linalg.svd(loadings, full_matrices=True)
        rest = u[:, int((s > 1e-10 * s.max()).sum()) :].T  # directions without any factor
        left = np.vstack([loadings.T, rest])
        right = np.vstack([np.linalg.pinv(loadings), rest]) @ cov * scale
    ones = np.ones((1, n)) if components is None else np.vstack([np.ones((1, n)), vector[:, components:].T])
    goal = np.append(1.0, np.zeros(len(ones) - 1))
    f, best = entropy_slope(left, right), (np.inf, None)
    starts = [np.ones(n), 1 / np.sqrt(np.diag(cov)), np.abs(vector[:, 0])]
    for start in starts:
        try:
            w = augmented_lagrangian(f, start / start.sum(), lambda x: (ones @ x - goal, ones), low=0.0, high=1.0, tol=1e-7)
        except ArithmeticError:
            continue
        found = f(w)[0]
        if found < best[0]:
            best = (found, w)
    if best[1] is None:
        raise ArithmeticError("no long-only portfolio meets the constraints")
    return best[1] / best[1].sum(), float(np.exp(-best[0]))
