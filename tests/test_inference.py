"""Bootstrap tests: block lengths and draws against plain loops, an edge told from noise."""

import hashlib
import math

import numpy as np
import pytest

from quantloom.operators.inference import STATISTICS, autocovariances, block_lengths, numbered, resampled_dates, statistics, superiority


def series(spark, x, names=None):
    names = names or [f"s{j}" for j in range(x.shape[1])]
    return spark.createDataFrame([(n, t, float(x[t, j])) for j, n in enumerate(names) for t in range(len(x))], "asset string, dt int, r double")


def plain_block(x):
    n = len(x)
    run, noise = max(5, math.ceil(math.sqrt(math.log10(n)))), 2 * math.sqrt(math.log10(n) / n)
    lags = min(n - 1, math.ceil(math.sqrt(n)) + run)
    e = x - x.mean()
    cov = [float(e[k:] @ e[: n - k]) / n for k in range(lags + 1)]
    loud = [k > 0 and abs(c / cov[0]) >= noise for k, c in enumerate(cov)]
    cut = next((k for k in range(lags + 1 - run) if not any(loud[k + 1 : k + 1 + run])), None)
    if cut is None:
        cut = max((k for k, v in enumerate(loud) if v), default=1)
    cut = max(cut, 1)
    reach = min(2 * cut, lags)
    weight = [max(0.0, min(1.0, 2 * (1 - k / reach))) * (2 if k else 1) * c for k, c in enumerate(cov)]
    level, slope = sum(weight), sum(k * w for k, w in enumerate(weight))
    return cut, max(1.0, min(math.ceil(min(3 * math.sqrt(n), n / 3)), (slope**2 / level**2 * n) ** (1 / 3)))


def dependent(seed, n=300):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 3))
    for t in range(1, n):
        x[t] = np.array([0.0, 0.5, 0.9]) * x[t - 1] + rng.normal(size=3)
    return x


def test_block_lengths_equal_a_plain_loop(spark):
    x = dependent(1)
    rows = numbered(series(spark, np.column_stack([x, np.full(len(x), 2.0)])))
    got = {r["asset"]: (r["cut"], r["block"]) for r in block_lengths(rows, len(x)).collect()}
    for j in range(3):
        cut, block = plain_block(x[:, j])
        assert got[f"s{j}"][0] == cut and math.isclose(got[f"s{j}"][1], block, rel_tol=1e-9)
    assert got["s0"][1] < got["s1"][1] < got["s2"][1] and got["s3"] == (1, 1.0)
    cov = {r["k"]: r["cov"] for r in autocovariances(rows, 4).where("asset = 's1'").collect()}
    e = x[:, 1] - x[:, 1].mean()
    assert all(math.isclose(cov[k], float(e[k:] @ e[: len(e) - k]) / len(e), rel_tol=1e-9) for k in range(5))


def plain_draws(n, replicates, block, seed):
    u = lambda kind, b, t: int(hashlib.md5(f"{seed},{kind},{b},{t}".encode()).hexdigest()[:8], 16) / 2**32
    out = {}
    for b in range(replicates):
        for t in range(n):
            if t == 0 or u("new", b, t) < 1 / block:
                at = int(u("start", b, t) * n)
            out[b, t] = at % n
            at += 1
    return out


def test_draws_equal_a_plain_loop_however_they_are_dealt(spark):
    want = plain_draws(37, 20, 4.5, 3)
    assert {(r["replicate"], r["t"]): r["rn"] for r in resampled_dates(spark, 37, 20, 4.5, 3).collect()} == want
    lengths = [sum(1 for t in range(1, 37) if want[b, t] != (want[b, t - 1] + 1) % 37) for b in range(20)]
    assert 4 < np.mean(lengths) < 12


def plain_statistic(r, statistic):
    if statistic == "mean":
        return r.mean(0)
    if statistic == "sharpe":
        return r.mean(0) / r.std(0, ddof=1)
    value = np.cumprod(1 + r, axis=0)
    return (value / np.maximum.accumulate(value, axis=0) - 1).min(0)


@pytest.mark.parametrize("statistic", STATISTICS)
def test_p_values_equal_a_plain_loop(spark, statistic):
    n, runs, rng = 50, 60, np.random.default_rng(7)
    x = rng.normal(0.01, 0.05, size=(n, 4))
    x[:, 1] += 0.01
    got = superiority(series(spark, x, ["a", "b", "c", "market"]), runs, 5.0, 3, statistic, "market").first()
    f = plain_statistic(x, statistic)
    f = f[:3] - f[3]
    draws = plain_draws(n, runs, 5.0, 3)
    again = np.array([(lambda v: v[:3] - v[3])(plain_statistic(x[[draws[b, t] for t in range(n)]], statistic)) for b in range(runs)])
    dev = math.sqrt(n) * again.std(0)
    centre = np.where(math.sqrt(n) * f >= -dev * math.sqrt(2 * math.log(math.log(n))), f, 0)
    top, spa = math.sqrt(n) * (again - f).max(1), np.maximum(0, (math.sqrt(n) * (again - centre) / dev).max(1))
    assert got["strategy"] == "abc"[int(f.argmax())] and math.isclose(got["statistic"], math.sqrt(n) * f.max(), rel_tol=1e-9)
    assert math.isclose(got["p_value"], (top > math.sqrt(n) * f.max()).mean(), abs_tol=1e-9)
    assert math.isclose(got["p_spa"], (spa > max(0, (math.sqrt(n) * f / dev).max())).mean(), abs_tol=1e-9)


@pytest.mark.parametrize("statistic", ["sharpe", "mean"])
def test_an_edge_is_told_from_noise(spark, statistic):
    x = np.random.default_rng(1).normal(size=(200, 5))
    noise = superiority(series(spark, x), 200, statistic=statistic).first()
    x[:, 2] += 0.6
    found = superiority(series(spark, x), 200, statistic=statistic).first()
    assert found["strategy"] == "s2" and found["p_value"] < 0.02 and found["p_spa"] < 0.02 and noise["p_value"] > 0.02 and noise["p_spa"] > 0.02


def test_dates_that_differ_are_refused(spark):
    rows = series(spark, np.random.default_rng(1).normal(size=(20, 2)))
    with pytest.raises(ValueError, match="same dates"):
        superiority(rows.where("asset = 's0' or dt > 3"), 10)
    with pytest.raises(ValueError, match="not one of"):
        superiority(rows, 10, statistic="skill")


def test_a_total_loss_is_a_fall_of_one(spark):
    rows = spark.createDataFrame([("a", t, r) for t, r in enumerate([0.1, -1.0, 0.5])], "asset string, t int, r double")
    assert math.isclose(statistics(rows, ["asset"], "drawdown").first()["value"], -1.0, abs_tol=1e-12)


def test_simulated_weights_and_what_they_earn(spark):
    from quantloom.operators.inference import monte_carlo

    x = np.random.default_rng(2).normal(0.01, 0.05, size=(40, 3))
    rules = {"equal": lambda c: np.full(len(c), 1 / len(c)), "inverse": lambda c: (1 / np.diag(c)) / (1 / np.diag(c)).sum()}
    got = {(r["sim"], r["strategy"]): r for r in monte_carlo(series(spark, x), rules, simulations=6, places=50, block=4.0, seed=2).collect()}
    assert len(got) == 12
    n, u = 40, lambda kind, b, t: int(hashlib.md5(f"2,{kind},{b},{t}".encode()).hexdigest()[:8], 16) / 2**32
    for b in range(6):
        drawn, at = [], 0
        for t in range(50):
            if t == 0 or u("new", b, t) < 1 / 4:
                at = int(u("start", b, t) * n)
            drawn.append(at % n)
            at += 1
        r = x[drawn]
        for name, rule in rules.items():
            w = rule(np.cov(r[:25].T))
            held = r[25:] @ w
            q = np.quantile(held, 0.05)
            want = {"vol": held.std(ddof=1), "sharpe": held.mean() / held.std(ddof=1), "var": -q, "es": -held[held <= q].mean(), "growth": np.log1p(held).sum(), "sspw": (w**2).sum()}
            assert all(math.isclose(got[b, name][k], v, rel_tol=1e-9) for k, v in want.items())
