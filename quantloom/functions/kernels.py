"""Small dense numerical problems, one group (fold, run or simulation) at a time; numpy only."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np


def single_linkage(points: np.ndarray) -> list[tuple[int, int]]:
    """Merges of single-linkage clustering of the rows of ``points``; cluster n + k is made by merge k."""
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    np.fill_diagonal(d, np.inf)
    n, alive, merges = len(points), {i: i for i in range(len(points))}, []
    for k in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        merges.append((alive[i], alive[j]))
        d[i] = d[:, i] = np.minimum(d[i], d[j])
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        alive[i] = n + k
    return merges


def leaf_order(merges: list[tuple[int, int]]) -> list[int]:
    """Leaves from left to right of the merge tree."""
    n, order = len(merges) + 1, [2 * len(merges)]
    while any(x >= n for x in order):
        order = [y for x in order for y in (merges[x - n] if x >= n else (x,))]
    return order


def correlation_distance(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    return np.sqrt(np.clip((1 - cov / np.outer(sd, sd)) / 2, 0, 1))


def cluster_variance(cov: np.ndarray, members: list[int]) -> float:
    part = cov[np.ix_(members, members)]
    w = 1 / np.diag(part)
    w /= w.sum()
    return float(w @ part @ w)


def hierarchical_parity(cov: np.ndarray) -> np.ndarray:
    """Risk split down the seriated order, inversely to the variances of the two halves of each interval of it. The
    rows of the distance matrix are the points that are clustered. Variances of intervals come from running sums
    over the ordered matrix: of 1 / variance for the weights inside, and of their products with covariances."""
    n = len(cov)
    order = np.array(leaf_order(single_linkage(correlation_distance(cov))) if n > 1 else [0])
    inverse = 1 / np.diag(cov)[order]
    total = np.concatenate([[0.0], np.cumsum(inverse)])
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = (cov[np.ix_(order, order)] * np.outer(inverse, inverse)).cumsum(0).cumsum(1)

    def variance(i: int, j: int) -> float:
        return (area[j, j] - 2 * area[i, j] + area[i, i]) / (total[j] - total[i]) ** 2

    share, open_ = np.ones(n), [(0, n)]
    while open_:
        i, j = open_.pop()
        if j - i > 1:
            m = (i + j) // 2
            left, right = variance(i, m), variance(m, j)
            share[i:m] *= right / (left + right)
            share[m:j] *= left / (left + right)
            open_ += [(i, m), (m, j)]
    w = np.empty(n)
    w[order] = share
    return w


def tree_cut(cov: np.ndarray, merges: list[tuple[int, int]], members: list[list[int]]) -> int:
    """Number of clusters where the cohesion of the tree's cuts bends most."""
    n = len(cov)
    d = correlation_distance(cov)
    cohesion, top = [], [2 * n - 2]
    for _ in range(min(n, 10)):
        cohesion.append(sum(d[np.ix_(members[c], members[c])].sum() / (2 * len(members[c])) for c in top))
        big = max((c for c in top if c >= n), default=None)
        if big is None:
            break
        top = [c for c in top if c != big] + list(merges[big - n])
    second = [cohesion[i - 1] - 2 * cohesion[i] + cohesion[i + 1] for i in range(1, len(cohesion) - 1)]
    return int(np.argmax(second)) + 2 if second else 1


def tree_sides(cov: np.ndarray, k: int | None = None) -> tuple[dict[int, tuple[int | None, list[int]]], set[int]]:
    """({node: (sibling, members)} of the splits of the tree down to ``k`` clusters, the clusters' nodes)."""
    n = len(cov)
    merges = single_linkage(correlation_distance(cov)) if n > 1 else []
    members = [[i] for i in range(n)]
    for a, b in merges:
        members.append(members[a] + members[b])
    k = tree_cut(cov, merges, members) if k is None else k
    top, sides = {2 * n - 2}, {}
    while len(top) < min(k, n):
        big = max(top)
        a, b = merges[big - n]
        sides[a], sides[b] = (b, members[a]), (a, members[b])
        top = top - {big} | {a, b}
    return sides or {2 * n - 2: (None, members[-1])}, top


def scaled_within(w: np.ndarray, lower: float, upper: float) -> np.ndarray:
    """w times one factor, clipped, with the sum of w; all NaN where there is none. The sum grows with the factor, in
    straight lines between the factors at which some entry meets a bound."""
    total = w.sum()
    if not (w >= 0).all() or not lower * len(w) - 1e-12 <= total <= upper * len(w) + 1e-12:
        return np.full(len(w), np.nan)
    some = w[w > 0]
    knots = np.unique(np.concatenate([[0.0], lower / some, upper / some]))
    sums = np.array([np.clip(f * w, lower, upper).sum() for f in knots])
    if not sums[0] - 1e-12 <= total <= sums[-1] + 1e-12:
        return np.full(len(w), np.nan)
    return np.clip(np.interp(total, sums, knots) * w, lower, upper)


def hierarchical_equal_risk(cov: np.ndarray, k: int | None = None) -> np.ndarray:
    """Clusters of a tree cut at the largest second difference of cohesion share risk by inverse variance down
    the tree; inside a cluster weights are inverse to variance."""
    n = len(cov)
    merges = single_linkage(correlation_distance(cov))
    members = [[i] for i in range(n)]
    for a, b in merges:
        members.append(members[a] + members[b])
    if k is None:
        k = tree_cut(cov, merges, members)
    share, top = {2 * n - 2: 1.0}, [2 * n - 2]
    while len(top) < min(k, n):
        big = max(c for c in top if c >= n)
        a, b = merges[big - n]
        va, vb = cluster_variance(cov, members[a]), cluster_variance(cov, members[b])
        share[a], share[b] = share[big] * vb / (va + vb), share[big] * va / (va + vb)
        top = [c for c in top if c != big] + [a, b]
    w = np.zeros(n)
    for c in top:
        inverse = 1 / np.diag(cov)[members[c]]
        w[members[c]] = share[c] * inverse / inverse.sum()
    return w


def positive(cov: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """The matrix itself if its eigenvalues are at least ``floor`` of their mean; else with those raised to it and
    its diagonal restored. Missing entries off the diagonal count as 0; a matrix without variances has no answer."""
    cov = np.where(np.isnan(cov) & ~np.eye(len(cov), dtype=bool), 0, cov)
    if not np.isfinite(cov).all() or (np.diag(cov) <= 0).any():
        raise ValueError("a covariance matrix needs finite entries and variances above zero")
    value, vector = np.linalg.eigh(cov)
    least = floor * value.mean()
    if value[0] >= least:
        return cov
    raised = (vector * np.maximum(value, least)) @ vector.T
    scale = np.sqrt(np.diag(cov) / np.diag(raised))
    return raised * np.outer(scale, scale)


def risk_budget(cov: np.ndarray, budget: np.ndarray | None = None, rounds: int = 500, tol: float = 1e-12) -> np.ndarray:
    """Long-only weights whose shares of variance equal ``budget`` (even if None): the minimum of half the variance
    less the budgets' weighted logarithms, by Newton steps damped as the function is self-concordant. The
    covariance must be positive definite. Raises if the steps do not settle."""
    n = len(cov)
    b = np.full(n, 1 / n) if budget is None else budget / budget.sum()
    c = cov / np.diag(cov).mean()
    x = np.sqrt(b / np.diag(c))
    for _ in range(rounds):
        slope = c @ x - b / x
        step = np.linalg.solve(c + np.diag(b / x**2), slope)
        size = np.sqrt(max(0.0, slope @ step) / b.min())
        x -= step / (1 + size) if size > 0.25 else step
        if size < tol**0.5:
            return x / x.sum()
    raise ArithmeticError(f"risk budgets did not settle in {rounds} rounds")


def risk_shares(cov: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w * (cov @ w) / (w @ cov @ w)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(10 * a.shape[1]):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        if gain.max(initial=-np.inf) <= tol:
            break
        free[int(np.argmax(gain))] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 0:
                break
            low = free & (s <= 0)
            step = (x[low] / (x[low] - s[low])).min()
            x += step * (s - x)
            free &= x > tol
            x[~free] = 0
        x = s
    return x


def long_only_minimum_variance(cov: np.ndarray, weight: float = 1e4) -> np.ndarray:
    """The minimum-variance corner of the efficient frontier, as least squares on the covariance's root with a
    heavy row for the budget."""
    value, vector = np.linalg.eigh(cov)
    root = (vector * np.sqrt(np.maximum(value, 0))) @ vector.T
    scale = weight * np.sqrt(np.trace(cov) / len(cov))
    w = nonnegative_least_squares(np.vstack([root, np.full(len(cov), scale)]), np.append(np.zeros(len(cov)), scale))
    return w / w.sum()


def efficient_frontier(mean: np.ndarray, cov: np.ndarray, points: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(targets, weights): least long-only variance for each mean from that of the least variance to the largest."""
    value, vector = np.linalg.eigh(cov)
    root = (vector * np.sqrt(np.maximum(value, 0))) @ vector.T
    unit = np.sqrt(np.trace(cov) / len(cov))
    least = long_only_minimum_variance(cov) @ mean
    targets, spread = np.linspace(least, mean.max(), points), max(np.ptp(mean), 1e-12)
    out = []
    for t in targets:
        rows = np.vstack([root, np.full(len(cov), 1e4 * unit), 1e4 * unit * (mean - t) / spread])
        w = nonnegative_least_squares(rows, np.concatenate([np.zeros(len(cov)), [1e4 * unit, 0.0]]))
        out.append(w / w.sum())
    return targets, np.array(out)


def symmetric_root(m: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh(m)
    return (vector * np.sqrt(np.maximum(value, 0))) @ vector.T


def minimum_torsion(cov: np.ndarray, rounds: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """The decorrelating map that disturbs the factors least (Meucci, Santangelo and Deguest 2015). With C the
    correlations and R its root, uncorrelated factors are D Q R^-1 of the scaled ones for some orthogonal Q and
    scales D; the trace of D Q R is largest where Q is the orthogonal part of the polar decomposition of D R, and
    D the diagonal of Q R. Both are taken in turn until D settles; raises if it does not."""
    sd = np.sqrt(np.diag(cov))
    root = symmetric_root(cov / np.outer(sd, sd))
    scale = np.ones(len(cov))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(scale[:, None] * root)
        turn = left @ right
        new = np.einsum("ij,ji->i", turn, root)
        if np.abs(new - scale).max() < tol:
            return (sd * new)[:, None] * (turn @ np.linalg.inv(root)) / sd
        scale = new
    raise ArithmeticError(f"the torsion did not settle in {rounds} rounds")


def effective_bets(cov: np.ndarray, w: np.ndarray, torsion: np.ndarray) -> float:
    exposure = np.linalg.solve(torsion.T, w)
    p = exposure * (torsion @ cov @ w) / (w @ cov @ w)
    return float(np.exp(-np.sum(p * np.log(1 + 1e-6 * (p <= 0) + np.where(p > 0, p - 1, 0)))))


def nearest_groups(x: np.ndarray, k: int, seed: int, starts: int = 10, rounds: int = 100) -> np.ndarray:
    """k-means labels of the rows of x, the best of several spread-out starts."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), int))
    for _ in range(starts):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            labels = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        cost = ((x - centres[labels]) ** 2).sum()
        if cost < best[0]:
            best = (cost, labels)
    return best[1]


def convex_factors(gram: np.ndarray, labels: np.ndarray, k: int, rounds: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Convex factorisation X ~ X W G' from the Gram matrix X'X alone: (W, G, losses)."""
    g = np.eye(k)[labels] + 0.2
    w = g / np.maximum(1, np.bincount(labels, minlength=k))
    up, down = (np.abs(gram) + gram) / 2, (np.abs(gram) - gram) / 2
    losses = []
    for i in range(rounds):
        g = g * np.sqrt((up @ w + g @ (w.T @ down @ w)) / (down @ w + g @ (w.T @ up @ w) + 1e-12))
        w = w * np.sqrt((up @ g + down @ w @ (g.T @ g)) / (down @ g + up @ w @ (g.T @ g) + 1e-12))
        losses.append(float(np.trace(gram) - 2 * np.trace(g.T @ gram @ w) + np.trace(g.T @ g @ w.T @ gram @ w)))
        if i % 10 == 9 and i > 9 and abs(losses[-11] - losses[-1]) < tol * abs(losses[0]):
            break
    return w, g, losses


def semi_factors(gram: np.ndarray, labels: np.ndarray, k: int, rounds: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """Semi-nonnegative factorisation X ~ F G' with F = X G (G'G)^-1, from the Gram matrix: (G, losses)."""
    g, losses = np.eye(k)[labels] + 0.2, []
    for i in range(rounds):
        inner = np.linalg.pinv(g.T @ g)
        xf = gram @ g @ inner
        ff = inner @ g.T @ gram @ g @ inner
        pos, neg = lambda m: (np.abs(m) + m) / 2, lambda m: (np.abs(m) - m) / 2
        g = g * np.sqrt((pos(xf) + g @ neg(ff)) / (neg(xf) + g @ pos(ff) + 1e-12))
        inner = np.linalg.pinv(g.T @ g)
        losses.append(float(np.trace(gram) - np.trace(inner @ g.T @ gram @ g)))
        if i % 10 == 9 and i > 9 and abs(losses[-11] - losses[-1]) < tol * abs(losses[0]):
            break
    return g, losses


def _bent(knots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, values) of the three quadratic B-splines that are not zero at each place: the first one's number, and
    their values there. ``knots`` begin and end with three equal ones."""
    i = np.clip(np.searchsorted(knots, at, "right") - 1, 2, len(knots) - 4)
    a, b, c, d = knots[i - 1], knots[i], knots[i + 1], knots[i + 2]
    first, last = (c - at) ** 2 / ((c - a) * (c - b)), (at - b) ** 2 / ((d - b) * (c - b))
    return i - 2, np.column_stack([first, 1 - first - last, last])


def quadratic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Quadratic spline through known points (x ascending), joints at the midpoints of inner intervals (the first and
    last joint left out); NaN outside the known range. Fewer than three points: a line or a constant.

    At a known point only the B-splines of its own number and the two beside it are not zero, so the coefficients
    solve a system with three diagonals: time and memory grow with the points."""
    inside = (at >= x[0]) & (at <= x[-1]) if len(x) else np.zeros(len(at), bool)
    if len(x) < 3:
        return np.where(inside, np.interp(at, x, y), np.nan) if len(x) else np.full(len(at), np.nan)
    n = len(x)
    middle = (x[1:] + x[:-1]) / 2
    knots = np.concatenate([np.full(3, x[0]), middle[1:-1], np.full(3, x[-1])])
    first, values = _bent(knots, x)
    rows = np.zeros((n, 5))  # of each point: the splines numbered from two below its own to two above
    rows[np.arange(n)[:, None], first[:, None] + np.arange(3) - np.arange(n)[:, None] + 2] = values
    low, own, up, right = rows[:, 1].tolist(), rows[:, 2].tolist(), rows[:, 3].tolist(), y.astype(float).tolist()
    for i in range(1, n):
        ratio = low[i] / own[i - 1]
        own[i] -= ratio * up[i - 1]
        right[i] -= ratio * right[i - 1]
    for i in range(n - 1, -1, -1):
        right[i] = (right[i] - (up[i] * right[i + 1] if i + 1 < n else 0.0)) / own[i]
    first, values = _bent(knots, np.clip(at, x[0], x[-1]))
    fitted = (np.array(right)[first[:, None] + np.arange(3)] * values).sum(1)
    return np.where(inside, fitted, np.nan)


def nelder_mead(f, start: np.ndarray, step: float = 0.1, rounds: int = 600, tol: float = 1e-9) -> np.ndarray:
    """Downhill simplex minimum of f."""
    pts = [np.asarray(start, float)] + [start + step * e * np.maximum(1, np.abs(start)) for e in np.eye(len(start))]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < tol * (abs(val[0]) + tol):
            break
        centre = np.mean(pts[:-1], axis=0)
        trial = [(q := centre + a * (pts[-1] - centre), f(q)) for a in (-1.0, -2.0, 0.5)]
        p, v = trial[0]
        if v < val[0]:
            p, v = min(trial[:2], key=lambda t: t[1])
        elif v >= val[-2]:
            p, v = trial[2]
        if v < val[-1]:
            pts[-1], val[-1] = p, v
        else:
            pts = [pts[0]] + [(q + pts[0]) / 2 for q in pts[1:]]
            val = [val[0]] + [f(q) for q in pts[1:]]
    return pts[int(np.argmin(val))]


def garch_variance(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    """Conditional variances, one more than there are returns: the last is the forecast."""
    h = np.empty(len(r) + 1)
    h[0] = r.var()
    for t in range(len(r)):
        h[t + 1] = omega + alpha * r[t] ** 2 + beta * h[t]
    return h


def garch_fit(r: np.ndarray) -> tuple[float, float, float]:
    """Normal maximum likelihood of (omega, alpha, beta) on demeaned returns, kept positive and stationary."""

    def params(z: np.ndarray) -> tuple[float, float, float]:
        e = np.exp(np.clip(z, -30, 30))
        total = 1 + e[1] + e[2]
        return e[0] * r.var(), e[1] / total, e[2] / total

    def loss(z: np.ndarray) -> float:
        h = garch_variance(r, *params(z))[:-1]
        return float(0.5 * (np.log(h) + r**2 / h).sum())

    return params(nelder_mead(loss, np.array([-1.5, 0.5, 1.5])))


def pareto_fit(excess: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of the generalised Pareto law of positive excesses, by maximum likelihood."""

    def loss(z: np.ndarray) -> float:
        shape, scale = z[0], np.exp(z[1])
        inside = 1 + shape * excess / scale
        if (inside <= 0).any():
            return 1e12
        if abs(shape) < 1e-8:
            return float(len(excess) * z[1] + excess.sum() / scale)
        return float(len(excess) * z[1] + (1 + 1 / shape) * np.log(inside).sum())

    shape, log_scale = nelder_mead(loss, np.array([0.1, np.log(excess.mean())]))
    return float(shape), float(np.exp(log_scale))


def stationary_indices(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """Row numbers of a stationary bootstrap with blocks of geometric length."""
    out, at = np.empty(n, int), int(rng.integers(n))
    fresh, starts = rng.random(n) < 1 / block, rng.integers(n, size=n)
    for i in range(n):
        at = int(starts[i]) if fresh[i] or i == 0 else (at + 1) % n
        out[i] = at
    return out


def block_permutation(n: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """Rows 0 to n - 1 in whole blocks of ``length`` in random order, without replacement. The list counts the last
    block as if it were whole and ends after n places, so unless that block comes last, the rows behind are lost."""
    block = rng.permutation(-(-n // length))
    places = np.minimum(length, n - np.arange(len(block)) * length)  # what the list still has room for
    return np.concatenate([np.arange(b * length, min(n, b * length + room)) for b, room in zip(block, places, strict=True)])


def factor_risk(cov: np.ndarray, w: np.ndarray, loadings: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the portfolio's variance that belong to the factors, and the share outside their span."""
    span = np.linalg.pinv(loadings)
    shares = (loadings.T @ w) * (span @ cov @ w) / (w @ cov @ w)
    return shares, float(1 - shares.sum())


def principal_bets(cov: np.ndarray, w: np.ndarray) -> float:
    """Exponential entropy of the variance shares of the principal portfolios."""
    value, vector = np.linalg.eigh(cov)
    p = (vector.T @ w) ** 2 * np.maximum(value, 0)
    p = p[p > 1e-15 * p.sum()] / p.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def silhouette_score(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette from a distance matrix; points alone in their cluster count zero."""
    out = np.zeros(len(d))
    for i in range(len(d)):
        mine = (labels == labels[i]) & (np.arange(len(d)) != i)
        others = [d[i, labels == c].mean() for c in set(labels.tolist()) - {labels[i]}]
        if mine.any() and others:
            a, b = d[i, mine].mean(), min(others)
            out[i] = (b - a) / max(a, b)
    return float(out.mean())


def next_loss_probability(r: np.ndarray) -> float:
    """Chance that the next return is not above zero, under a normal law with constant variance or GARCH(1, 1),
    whichever has the lesser AIC on the returns given."""
    mean = r.mean()
    e = r - mean
    if not e.any():
        return float(mean <= 0)
    plain = 2 * 2 + len(e) * (np.log(e.var()) + 1)
    fitted = garch_variance(e, *garch_fit(e))
    aic = 2 * 4 + (np.log(fitted[:-1]) + e**2 / fitted[:-1]).sum()
    sd = np.sqrt(fitted[-1] if aic < plain else e.var())
    return NormalDist().cdf(-mean / sd)
