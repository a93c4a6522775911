"""Weights down a tree against plain code, bounds against their conditions."""

import datetime

import numpy as np
import pytest

from quantloom.functions import kernels as K
from quantloom.operators.grouped import fold_covariances
from quantloom.operators.hierarchy import LEAST_RISK, cluster_nodes, hierarchical_weights, within_bounds


def measures(r):
    def tail(x):
        return -x[x <= np.quantile(x, 0.05)].mean()

    value = np.cumprod(1 + r)
    found = {"equal": 1.0, "vol": r.std(ddof=1), "es": tail(r), "cdar": tail(value / np.maximum.accumulate(value) - 1)}
    return {k: max(v, LEAST_RISK) for k, v in found.items()}


def plain(r, sides, clusters, measure):
    risk, w = np.array([measures(x)[measure] for x in r.T]), np.zeros(r.shape[1])
    inside = {node: (1 / risk[m]) / (1 / risk[m]).sum() for node, (_, m) in sides.items()}
    of = {node: measures(r[:, m] @ inside[node])[measure] for node, (_, m) in sides.items()}
    for c in clusters:
        w[sides[c][1]] = inside[c]
    for node, (sibling, m) in sides.items():
        w[m] *= 1 if sibling is None else of[sibling] / (of[node] + of[sibling])
    return w


@pytest.mark.parametrize("k", [None, 1, 4])
def test_weights_equal_plain_code(spark, k):
    rng = np.random.default_rng(5)
    common = rng.standard_normal((90, 3))
    r = 0.02 * (common[:, [0, 0, 1, 1, 2, 2, 0]] + 0.5 * rng.standard_normal((90, 7))) * np.linspace(0.5, 2, 7)
    day = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(90)]
    rows = [(0, "train", f"a{j}", day[i], float(r[i, j])) for i in range(90) for j in range(7)] + [(0, "test", "a0", datetime.date(2021, 1, 1), 0.9)]
    split = spark.createDataFrame(rows, "cv int, split string, asset string, dt date, r double")
    got = hierarchical_weights(split, cluster_nodes(fold_covariances(split), k)).toPandas()
    sides, clusters = K.tree_sides(np.cov(r.T), k)
    assert k is None or len(clusters) == k
    for measure in ("equal", "vol", "es", "cdar"):
        mine = got[got["strategy"] == f"herc_{measure}"].sort_values("asset")["w"].to_numpy()
        assert np.allclose(mine, plain(r, sides, clusters, measure), atol=1e-9) and abs(mine.sum() - 1) < 1e-9


def test_one_asset_and_no_rows(spark):
    schema = "cv int, split string, asset string, dt date, r double"
    one = spark.createDataFrame([(0, "train", "a", datetime.date(2020, 1, i), 0.01 * (i % 3 - 1)) for i in range(1, 20)], schema)
    assert [x["w"] for x in hierarchical_weights(one, cluster_nodes(fold_covariances(one))).collect()] == [1.0] * 4
    none = one.where("false")
    assert hierarchical_weights(none, cluster_nodes(fold_covariances(none))).count() == 0


def test_bounds_scale_what_is_free():
    rng = np.random.default_rng(6)
    for _ in range(200):
        w = rng.dirichlet(np.full(8, 0.5))
        got = K.scaled_within(w, 0.03, 0.3)
        free = (got > 0.03 + 1e-12) & (got < 0.3 - 1e-12)
        assert abs(got.sum() - 1) < 1e-9 and got.min() >= 0.03 and got.max() <= 0.3
        factor = got[free] / w[free]
        assert np.ptp(factor) < 1e-8 if free.any() else True
        if free.any():
            assert (w[got <= 0.03 + 1e-12] * factor[0] <= 0.03 + 1e-8).all() and (w[got >= 0.3 - 1e-12] * factor[0] >= 0.3 - 1e-8).all()
    w = np.array([0.5, 0.3, 0.2])
    assert np.allclose(K.scaled_within(w, 0, 1), w) and np.allclose(K.scaled_within(w, 0, 0.4), [0.4, 0.36, 0.24])
    assert np.isnan(K.scaled_within(w, 0, 0.3)).all() and np.isnan(K.scaled_within(np.array([0.0, 1.0]), 0, 0.5)).all()


def test_bounds_by_portfolio(spark):
    rows = [(0, "x", "a", 0.5), (0, "x", "b", 0.3), (0, "x", "c", 0.2), (1, "x", "a", 1.0)]
    got = within_bounds(spark.createDataFrame(rows, "cv int, strategy string, asset string, w double"), 0, 0.4).collect()
    assert {(x["cv"], x["asset"]): x["bounded"] and round(x["bounded"], 9) for x in got} == {(0, "a"): 0.4, (0, "b"): 0.36, (0, "c"): 0.24, (1, "a"): None}
