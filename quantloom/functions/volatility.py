"""ARMA means with GARCH variances under normal, Student and skewed laws, fitted to many series at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import erf, lgamma, pi

import numpy as np

LAWS = ("norm", "std", "snorm", "sstd")
_lgamma = np.frompyfunc(lgamma, 1, 1)
_erf = np.frompyfunc(erf, 1, 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(_lgamma(x), float)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.asarray(_erf(np.asarray(x, float) / np.sqrt(2)), float))


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function by Lentz's method; quick where x < (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, rounds):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out *= c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    return out


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(a * np.log(inner) + b * np.log1p(-inner) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
    left = inner < (a + 1) / (a + b + 2)
    u, p, q = np.where(left, inner, 1 - inner), np.where(left, a, b), np.where(left, b, a)
    part = front * _beta_fraction(u, p, q) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(left, part, 1 - part)))


def student_cdf(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Distribution of a Student variable of ``shape`` degrees of freedom, scaled to variance one."""
    t2 = np.square(x) * shape / (shape - 2)
    tail = 0.5 * incomplete_beta(shape / (shape + t2), shape / 2, np.full_like(t2, 0.5))
    return np.where(np.asarray(x) > 0, 1 - tail, tail)


def _moment(shape: np.ndarray | None) -> np.ndarray:
    """Mean of the absolute value of a normal variable, or of a Student variable of variance one."""
    if shape is None:
        return np.array(2 / np.sqrt(2 * pi))
    return 2 * np.sqrt(shape - 2) / (shape - 1) * np.exp(log_gamma((shape + 1) / 2) - log_gamma(shape / 2)) / np.sqrt(pi)


def _unskewed(x: np.ndarray, skew: np.ndarray, shape: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a law with mean 0 and variance 1 that is stretched by ``skew`` above its mode and by 1 / skew below: the
    place of x on the law before, the side's stretch, and the scale."""
    m = _moment(shape)
    mode = m * (skew - 1 / skew)
    scale = np.sqrt((1 - m**2) * (skew**2 + skew**-2) + 2 * m**2 - 1)
    z = x * scale + mode
    return z, np.where(z >= 0, skew, 1 / skew), scale


def _symmetric_log_density(z: np.ndarray, shape: np.ndarray | None) -> np.ndarray:
    if shape is None:
        return -0.5 * (z * z + np.log(2 * pi))
    front = log_gamma((shape + 1) / 2) - log_gamma(shape / 2) - 0.5 * np.log(pi * (shape - 2))
    return front - (shape + 1) / 2 * np.log1p(z * z / (shape - 2))


def log_density(x: np.ndarray, skew: np.ndarray | None = None, shape: np.ndarray | None = None) -> np.ndarray:
    """Log density of a law of mean 0 and variance 1: normal, Student with a ``shape``, skewed with a ``skew``."""
    if skew is None:
        return _symmetric_log_density(x, shape)
    z, side, scale = _unskewed(x, skew, shape)
    return np.log(2 / (skew + 1 / skew) * scale) + _symmetric_log_density(z / side, shape)


def cdf(x: np.ndarray, skew: np.ndarray | None = None, shape: np.ndarray | None = None) -> np.ndarray:
    """Distribution of the same laws."""
    below = normal_cdf if shape is None else lambda v: student_cdf(v, shape)
    if skew is None:
        return below(x)
    z, side, _ = _unskewed(x, skew, shape)
    part = 2 / (skew + 1 / skew) * side * below(-np.abs(z) / side)
    return np.where(z >= 0, 1 - part, part)


def minimise(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, used: np.ndarray | None = None, rounds: int = 120, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """(points, values): minima of many functions at a time by quasi-Newton steps (BFGS). ``f`` gets points and the
    number of the function for each; numbers not ``used`` by a function stay. Slopes are central differences; of steps
    halved eight times the best is taken.
    A problem is left as it is once a step, from a fresh start too, wins less than ``tol``."""
    x, n, d = start.astype(float).copy(), *start.shape
    used = np.ones((n, d), bool) if used is None else used
    value, inverse = f(x, np.arange(n)), np.tile(np.eye(d), (n, 1, 1))
    slope, fresh, live = np.zeros((n, d)), np.ones(n, bool), np.isfinite(value)

    def slopes(at: np.ndarray) -> np.ndarray:
        row, number = np.nonzero(used[at])
        h = 1e-5 * np.maximum(1, np.abs(x[at[row], number]))
        moved = np.repeat(x[at[row]][None], 2, axis=0)
        moved[0, np.arange(len(row)), number] += h
        moved[1, np.arange(len(row)), number] -= h
        v = f(moved.reshape(-1, d), np.tile(at[row], 2)).reshape(2, -1)
        g = np.zeros((len(at), d))
        g[row, number] = np.nan_to_num((v[0] - v[1]) / (2 * h), posinf=0.0, neginf=0.0)
        return g

    slope[live] = slopes(np.flatnonzero(live))
    lengths = 0.5 ** np.arange(9)
    for _ in range(rounds):
        at = np.flatnonzero(live)
        if not len(at):
            break
        step = -np.einsum("nij,nj->ni", inverse[at], slope[at])
        uphill = (step * slope[at]).sum(1) >= 0
        step[uphill] = -slope[at][uphill]
        step *= np.minimum(1, 2 / np.maximum(np.abs(step).max(1, keepdims=True), 1e-300))
        tried = x[at, None, :] + lengths[None, :, None] * step[:, None, :]
        v = f(tried.reshape(-1, d), np.repeat(at, len(lengths))).reshape(len(at), -1)
        v = np.where(np.isfinite(v), v, np.inf)
        best = v.argmin(1)
        won = value[at] - v[np.arange(len(at)), best]
        good = won > 0
        move, before, old = at[good], slope[at[good]].copy(), x[at[good]].copy()
        x[move], value[move] = tried[good, best[good]], v[good, best[good]]
        stuck = won < tol * (1 + np.abs(value[at]))
        live[at[stuck & fresh[at]]] = False
        inverse[at[stuck]] = np.eye(d)
        fresh[at] = stuck
        if len(move):
            slope[move] = slopes(move)
            s, y = x[move] - old, slope[move] - before
            sy = (s * y).sum(1)
            ok = (sy > 1e-10 * np.linalg.norm(s, axis=1) * np.linalg.norm(y, axis=1)) & ~fresh[move]
            s, y, r, k = s[ok], y[ok], 1 / sy[ok], move[ok]
            left = np.eye(d)[None] - r[:, None, None] * s[:, :, None] * y[:, None, :]
            inverse[k] = left @ inverse[k] @ left.transpose(0, 2, 1) + r[:, None, None] * s[:, :, None] * s[:, None, :]
    return x, value


@dataclass(frozen=True)
class Spec:
    """An ARMA(ar, ma) mean (``mean`` False: none), a variance with ``p`` squared errors and ``q`` variances before, each up
    to two, and a law. With p = 0 the variance is constant."""

    ar: int = 0
    ma: int = 0
    p: int = 1
    q: int = 1
    law: str = "norm"
    mean: bool = True

    @property
    def shaped(self) -> bool:
        return self.law in ("std", "sstd")

    @property
    def skewed(self) -> bool:
        return self.law in ("snorm", "sstd")

    @property
    def size(self) -> int:
        return self.mean + self.ar + self.ma + 1 + self.p + self.q + self.shaped + self.skewed


class Models:
    """A model for each of many rows, all with the same twelve numbers, of which a row uses those of its model: the
    mean's constant, two and two of its terms, the variance's constant, two and two of its terms, shape and skew."""

    def __init__(self, specs: list[Spec]):
        column = lambda f: np.array([f(s) for s in specs], float)
        self.mean, self.size = column(lambda s: s.mean), column(lambda s: s.size)
        upto = lambda f: column(f)[:, None] > np.arange(2)[None]
        self.ar, self.ma, self.p, self.q = upto(lambda s: s.ar), upto(lambda s: s.ma), upto(lambda s: s.p), upto(lambda s: s.q)
        self.shaped, self.skewed = column(lambda s: s.shaped) > 0, column(lambda s: s.skewed) > 0
        one = np.ones(len(specs), bool)
        self.used = np.column_stack([self.mean > 0, self.ar, self.ma, one, self.p, self.q, self.shaped, self.skewed])

    def of(self, rows: np.ndarray) -> "Models":
        out = object.__new__(Models)
        out.__dict__ = {k: v[rows] for k, v in self.__dict__.items()}
        return out

    def start(self, means: np.ndarray) -> np.ndarray:
        z = np.zeros((len(self.mean), 12))
        z[:, 0] = means * self.mean
        z[:, 5] = np.where(self.p[:, 0], -1.0, 0.0)
        z[:, 6:8], z[:, 8:10], z[:, 10] = np.where(self.q[:, :1], -0.5, -1.0), 1.5, 1.5
        return z

    def read(self, z: np.ndarray) -> dict[str, np.ndarray]:
        """Parameters from unbounded numbers. Partial correlations within (-1, 1) keep the mean stationary and
        invertible, shares of one keep the variance stationary, and Student's shape is above 2.05."""

        def stable(r: np.ndarray, used: np.ndarray) -> np.ndarray:
            r = np.tanh(r) * used
            return np.column_stack([r[:, 0] * (1 - r[:, 1]), r[:, 1]])

        e = np.exp(np.clip(z[:, 6:10], -30, 30)) * np.hstack([self.p, self.q])
        shares = 0.9999 * e / (1 + e.sum(1, keepdims=True))
        out = {"mu": z[:, 0] * self.mean, "ar": stable(z[:, 1:3], self.ar), "ma": stable(z[:, 3:5], self.ma)}
        out |= {"omega": np.exp(np.clip(z[:, 5], -20, 20)), "alpha": shares[:, :2], "beta": shares[:, 2:]}
        return out | {"shape": 2.05 + np.exp(np.clip(z[:, 10], -20, 5)), "skew": np.exp(np.clip(z[:, 11], -3, 3))}

    def filtered(self, x: np.ndarray, begin: np.ndarray, at: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(errors, variances, mean ahead): the recursions over the columns of ``x``. A row's errors count from its place
        ``begin`` on, with two values before it; errors before are zero, and variances the row's own. The last variance
        and mean are forecasts."""
        rows, n = x.shape
        count = np.maximum(n + 2 - begin, 1)
        own = np.maximum((x * x).sum(1) / count - (x.sum(1) / count) ** 2, 1e-12)
        errors, square, variances = np.zeros((n, rows)), np.tile(own, (n, 1)), np.tile(own, (n + 1, 1))
        x, ar, ma, alpha, beta = x.T, at["ar"].T, at["ma"].T, at["alpha"].T, at["beta"].T
        mean = at["mu"]
        for t in range(2, n + 1):
            open_ = t >= begin
            mean = at["mu"] + ar[0] * x[t - 1] + ar[1] * x[t - 2] + ma[0] * errors[t - 1] + ma[1] * errors[t - 2]
            h = at["omega"] + alpha[0] * square[t - 1] + alpha[1] * square[t - 2] + beta[0] * variances[t - 1] + beta[1] * variances[t - 2]
            variances[t] = np.where(open_, h, own)
            if t < n:
                e = np.where(open_, x[t] - mean, 0.0)
                errors[t], square[t] = e, np.where(open_, e * e, own)
        return errors.T, variances.T, mean

    def by_law(self, f, z: np.ndarray, at: dict[str, np.ndarray]) -> np.ndarray:
        """``f`` (density or distribution) of standardised values, a row at a time by its law."""
        out = np.empty_like(z)
        for shaped in (False, True):
            for skewed in (False, True):
                some = np.flatnonzero((self.shaped == shaped) & (self.skewed == skewed))
                if len(some):
                    pick = lambda v: v[some].reshape(-1, *[1] * (z.ndim - 1))  # noqa: B023, E731
                    out[some] = f(z[some], pick(at["skew"]) if skewed else None, pick(at["shape"]) if shaped else None)
        return out

    def losses(self, x: np.ndarray, begin: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Negative log-likelihood, given the two values before ``begin``."""
        at = self.read(z)
        errors, variances, _ = self.filtered(x, begin, at)
        with np.errstate(all="ignore"):
            h = variances[:, :-1]
            terms = self.by_law(log_density, errors / np.sqrt(h), at) - 0.5 * np.log(h)
            return -np.where(np.arange(x.shape[1]) >= begin[:, None], terms, 0.0).sum(1)


@dataclass(frozen=True)
class Fit:
    """Fitted parameters of each series with AIC by observation (infinite where the fit failed), forecasts for the
    next value, standardised errors (NaN before they count) and the chance of a value not above zero."""

    at: dict[str, np.ndarray]
    aic: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    errors: np.ndarray
    chance: np.ndarray


def fit(series: list[np.ndarray], specs: list[Spec]) -> Fit:
    """Maximum likelihood of a model for each series, all at a time, whatever their lengths. Series are first divided by
    their deviations, and results are in units of the series as given. One without deviation, with values that are
    not finite, or with too few of them, has no fit."""
    sizes = np.array([len(x) for x in series])
    n = max(3, int(sizes.max(initial=0)))
    scale = np.array([np.std(x, ddof=1) if len(x) > 1 and np.isfinite(x).all() else 0.0 for x in series])
    models = Models(specs)
    good = (scale > 1e-300) & (sizes > 2 + models.size)
    x = np.zeros((len(series), n))
    for i in np.flatnonzero(good):
        x[i, n - sizes[i] :] = series[i] / scale[i]
    begin = n - sizes + 2
    z, value = models.start(x.sum(1) / np.maximum(sizes, 1)), np.full(len(series), np.inf)
    known = np.flatnonzero(good)
    if len(known):
        f = lambda p, row: models.of(known[row]).losses(x[known[row]], begin[known[row]], p)
        z[known], value[known] = minimise(f, z[known], models.used[known])
    at = models.read(z)
    errors, variances, mean = models.filtered(x, begin, at)
    with np.errstate(all="ignore"):
        sd = np.sqrt(variances[:, -1])
        standard = np.where(np.arange(n) >= begin[:, None], errors / np.sqrt(variances[:, :-1]), np.nan)
        chance = models.by_law(cdf, -mean / sd, at)
    good &= np.isfinite(value) & np.isfinite(chance)
    empty = lambda v: np.where(good, v, np.nan)
    aic = np.where(good, (2 * value + 2 * models.size) / np.maximum(1, sizes - 2), np.inf)
    return Fit(at, aic, empty(mean * scale), empty(sd * scale), standard, empty(chance))


def pareto_tails(errors: np.ndarray, threshold: np.ndarray, points: int = 65, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(shape, scale) of the generalised Pareto law of what exceeds each row's threshold, by maximum likelihood; NaN
    where fewer than ten values do. For a ratio of shape to scale the best shape is the mean of log(1 + ratio *
    excess); the ratio is searched on a grid that is drawn closer ``rounds`` times."""
    excess = np.nan_to_num(errors - threshold[:, None], nan=-1.0)
    over = excess > 0
    n = over.sum(1)
    good = n >= 10
    excess = np.where(over, excess, 0.0)
    mean, top = excess.sum(1) / np.maximum(n, 1), np.maximum(excess.max(1, initial=0), 1e-300)
    low, high = -(1 - 1e-6) / top, 20 / np.maximum(mean, 1e-300)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            at = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, points)
            shape = np.log1p(at[:, :, None] * excess[:, None, :]).sum(2) / np.maximum(n, 1)[:, None]
            flat = np.abs(at) * mean[:, None] < 1e-9
            value = np.where(flat, -np.log(mean)[:, None] - 1, -np.log(shape / at) - shape - 1)
            best = np.nanargmax(np.where((shape > -1) & np.isfinite(value), value, -np.inf), 1)
            row = np.arange(len(best))
            ratio, found = at[row, best], shape[row, best]
            low, high = at[row, np.maximum(best - 1, 0)], at[row, np.minimum(best + 1, points - 1)]
        scale = np.where(np.abs(ratio) * mean < 1e-9, mean, found / ratio)
    return np.where(good, found, np.nan), np.where(good, scale, np.nan)
