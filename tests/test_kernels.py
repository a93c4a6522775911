"""Numeric kernels on cases with known answers."""

import numpy as np

from quantloom.functions import kernels as K


def test_hierarchical_parity_on_a_diagonal_is_inverse_variance():
    cov = np.diag([1.0, 2, 3, 4, 5])
    want = 1 / np.diag(cov)
    assert np.allclose(K.hierarchical_parity(cov), want / want.sum())


def test_equal_risk_on_a_diagonal():
    assert np.allclose(K.risk_budget(np.diag([1.0, 4, 9])), [6 / 11, 3 / 11, 2 / 11])


def test_risk_shares_meet_the_budget():
    x = np.random.default_rng(1).normal(size=(200, 6))
    cov, b = np.cov(x.T), np.array([1.0, 2, 3, 4, 5, 6])
    assert np.allclose(K.risk_shares(cov, K.risk_budget(cov, b)), b / b.sum(), atol=1e-6)


def test_minimum_torsion_of_a_diagonal_is_the_identity():
    assert np.allclose(K.minimum_torsion(np.diag([1.0, 4, 9])), np.eye(3))


def test_effective_bets_of_equal_risk_counts_assets():
    cov = np.diag([1.0, 4, 9])
    assert abs(K.effective_bets(cov, K.risk_budget(cov), np.eye(3)) - 3) < 1e-6


def test_two_asset_minimum_variance():
    cov = np.array([[0.04, 0.006], [0.006, 0.09]])
    w = (0.09 - 0.006) / (0.04 + 0.09 - 0.012)
    assert np.allclose(K.long_only_minimum_variance(cov), [w, 1 - w], atol=1e-5)


def test_frontier_ends_at_the_largest_mean():
    mean, cov = np.array([0.1, 0.2, 0.15]), np.diag([0.04, 0.09, 0.05])
    targets, weights = K.efficient_frontier(mean, cov)
    assert np.allclose(weights @ mean, targets, atol=1e-4) and weights[-1][1] > 0.999


def test_factor_losses_fall():
    x = np.random.default_rng(2).normal(size=(60, 8))
    gram, labels = x.T @ x, np.arange(8) % 3
    for losses in (K.convex_factors(gram, labels, 3)[2], K.semi_factors(gram, labels, 3)[1]):
        assert all(b <= a + 1e-6 * abs(a) for a, b in zip(losses, losses[1:], strict=False))


def test_spline_reproduces_a_parabola():
    x = np.array([0.0, 1, 3, 4, 7, 9])
    at = np.linspace(0, 9, 19)
    assert np.allclose(K.quadratic_spline(x, 2 * x**2 - x + 1, at), 2 * at**2 - at + 1)
    assert np.isnan(K.quadratic_spline(x, x, np.array([-1.0, 10]))).all()


def test_nonnegative_least_squares():
    a, b = np.eye(3), np.array([1.0, -2, 3])
    assert np.allclose(K.nonnegative_least_squares(a, b), [1, 0, 3])


def test_pareto_fit_of_exponential_excesses():
    e = np.random.default_rng(3).exponential(2.0, 5000)
    shape, scale = K.pareto_fit(e)
    assert abs(shape) < 0.06 and abs(scale - 2) < 0.15


def test_block_permutation_ids():
    ids = K.block_permutation(250, 60, np.random.default_rng(0))
    assert len(ids) in (200, 250) and len(set(ids)) == len(ids) and ids.max() < 250


def test_groups_of_separate_points():
    x = np.vstack([np.zeros((5, 2)), np.ones((5, 2)) * 9])
    labels = K.nearest_groups(x, 2, 0)
    assert len(set(labels[:5])) == len(set(labels[5:])) == 1 and labels[0] != labels[9]


def test_factor_risk_of_all_assets_is_the_whole():
    cov = np.diag([1.0, 2, 3])
    shares, rest = K.factor_risk(cov, np.full(3, 1 / 3), np.eye(3))
    assert np.allclose(shares, np.diag(cov) / 6) and abs(rest) < 1e-12


def test_principal_bets_of_equal_variances():
    assert abs(K.principal_bets(np.diag([1.0, 2, 4]), np.array([1, 2**-0.5, 0.5])) - 3) < 1e-9


def test_silhouette_of_separate_groups_is_near_one():
    x = np.array([0, 0.1, 9, 9.1])
    assert K.silhouette_score(np.abs(x[:, None] - x), np.array([0, 0, 1, 1])) > 0.98
    assert K.silhouette_score(np.abs(x[:, None] - x), np.array([0, 1, 2, 3])) == 0


def test_parity_halves_follow_the_covariance():
    x = np.random.default_rng(4).normal(size=(80, 7))
    cov = np.cov((x @ np.random.default_rng(5).normal(size=(7, 7))).T)
    order = K.leaf_order(K.single_linkage(K.correlation_distance(cov)))
    w = np.ones(7)
    parts = [order]
    while parts:
        part = parts.pop()
        if len(part) > 1:
            a, b = part[: len(part) // 2], part[len(part) // 2 :]
            va, vb = K.cluster_variance(cov, a), K.cluster_variance(cov, b)
            w[a] *= vb / (va + vb)
            w[b] *= va / (va + vb)
            parts += [a, b]
    assert np.allclose(K.hierarchical_parity(cov), w)


def test_fewer_dates_than_assets():
    for dates in (4, 9, 30):
        cov = K.positive(np.cov(np.random.default_rng(dates).normal(size=(dates, 20)).T))
        w = K.risk_budget(cov)
        assert abs(w.sum() - 1) < 1e-12 and w.min() > 0 and np.allclose(K.risk_shares(cov, w), 1 / 20, atol=1e-8)
    assert np.array_equal(K.positive(np.diag([1.0, 2.0])), np.diag([1.0, 2.0]))


def test_covariance_without_variances_is_refused():
    import pytest

    for bad in (np.array([[0.0, 0], [0, 1]]), np.array([[np.nan, 0], [0, 1]])):
        with pytest.raises(ValueError):
            K.positive(bad)


def test_torsion_decorrelates():
    cov = np.cov(np.random.default_rng(6).normal(size=(50, 5)).T) + 0.3
    t = K.minimum_torsion(cov)
    made = t @ cov @ t.T
    assert np.allclose(made - np.diag(np.diag(made)), 0, atol=1e-8)


def test_block_permutation_is_distinct_rows():
    for seed in range(20):
        ids = K.block_permutation(250, 60, np.random.default_rng(seed))
        assert len(set(ids)) == len(ids) in (200, 250) and max(ids) < 250
        assert sum(int(b) != int(a) + 1 for a, b in zip(ids, ids[1:], strict=False)) <= 4


def test_spline_is_smooth_and_exact_on_many_points():
    import time

    rng = np.random.default_rng(8)
    x = np.cumsum(rng.choice([1.0, 1.0, 1.0, 3.0, 4.0], size=10_000))
    y = np.cumsum(rng.normal(size=10_000))
    began = time.time()
    fitted = K.quadratic_spline(x, y, x)
    assert time.time() - began < 1 and np.abs(fitted - y).max() < 1e-9
    joints = ((x[1:] + x[:-1]) / 2)[1:-1]
    h = 1e-4
    left, mid, right = (K.quadratic_spline(x, y, joints + s) for s in (-h, 0, h))
    assert np.abs((right - mid) - (mid - left)).max() < 1e-4  # no corner at a joint
    third = np.diff(K.quadratic_spline(x, y, np.linspace(joints[5] + 1e-6, joints[6] - 1e-6, 8)), 3)
    assert np.abs(third).max() < 1e-9  # a parabola between joints


def test_spline_equals_a_dense_solve():
    rng = np.random.default_rng(9)
    x, y = np.sort(rng.choice(60, 15, replace=False)).astype(float), rng.normal(size=15)
    at = np.linspace(x[0], x[-1], 200)
    knots = ((x[1:] + x[:-1]) / 2)[1:-1]
    design = lambda z: np.column_stack([np.ones(len(z)), z, z**2, *[np.maximum(0, z - k) ** 2 for k in knots]])
    assert np.allclose(K.quadratic_spline(x, y, at), design(at) @ np.linalg.solve(design(x), y), atol=1e-6)
