"""Numbers of factors: densities and inertias against brute force, planted groups found again."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import selection


def frame(spark, x, cv=0):
    dates, n = x.shape
    rows = [(cv, f"a{j:02d}", t, float(x[t, j])) for t in range(dates) for j in range(n)]
    return spark.createDataFrame(rows, "cv int, asset string, dt int, r double")


@pytest.mark.parametrize("bucket", [3, 1000])
def test_density_equals_that_over_all_pairs(spark, bucket):
    rng = np.random.default_rng(1)
    known, points = rng.normal(size=40), np.append(rng.normal(size=25) * 2, [900.0, 1e6])
    a = spark.createDataFrame([(0, float(v)) for v in known] + [(1, 0.5), (2, None)], "cv int, x double")
    b = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(points)] + [(1, 99, 0.5), (2, 98, 0.0)], "cv int, i int, x double")
    got = {r["i"]: r["log_density"] for r in selection.kernel_log_density(a, b, ["cv"], bucket).collect()}
    h = (40 * 0.75) ** -0.2
    for i, v in enumerate(points):
        t = -np.abs(v - known) / h
        want = t.max() + math.log(np.exp(t - t.max()).sum()) - math.log(2 * 40 * h)
        assert math.isclose(got[i], want, rel_tol=1e-9)
    assert math.isclose(got[99], -math.log(2 * 0.75**-0.2), rel_tol=1e-9) and 98 not in got


def test_residuals_and_grams_equal_those_of_matrices(spark):
    x = np.random.default_rng(2).normal(size=(50, 6)) @ np.random.default_rng(3).normal(size=(6, 6))
    rows = frame(spark, x)
    gram = {(r["a"], r["b"]): r["cov"] for r in selection.grams(rows, ["cv"]).collect()}
    want = x.T @ x
    assert len(gram) == 36 and all(math.isclose(gram[f"a{i:02d}", f"a{j:02d}"], want[i, j], rel_tol=1e-9) for i in range(6) for j in range(6))
    fits = selection.factor_fits(rows, ["cv"], range(1, 4))
    wide = fits.toPandas()
    got = {(r["k"], r["dt"]): r["e"] for r in selection.mean_residuals(rows, fits, ["cv"]).collect()}
    for k, some in wide.groupby("k"):
        mix, loading = (some.pivot(index="asset", columns="factor", values=v).to_numpy() for v in ("mix", "loading"))
        assert mix.shape == (6, k) and (mix >= 0).all() and (loading >= 0).all()
        e = (x - x @ mix @ loading.T).mean(1)
        assert np.allclose([got[k, t] for t in range(50)], e, atol=1e-9)


def test_aic_takes_the_least(spark):
    rows = [(0, k, t, float(v)) for k, spread in ((1, 1.0), (2, 0.1), (3, 0.1)) for t, v in enumerate(np.random.default_rng(4).normal(size=80) * spread)]
    got = {r["k"]: r for r in selection.density_aic(spark.createDataFrame(rows, "cv int, k int, dt int, e double"), ["cv"]).collect()}
    assert set(got) == {1, 2, 3} and {r["best"] for r in got.values()} == {min(got, key=lambda k: got[k]["aic"])} == {2}
    assert all(math.isclose(r["aic"], 2 * ((k - 1) - r["log_likelihood"]), rel_tol=1e-9) for k, r in got.items())


def test_inertia_equals_brute_force(spark):
    x, label = np.random.default_rng(5).normal(size=(30, 7)), [0, 0, 1, 1, 1, 2, 0]
    rows = [(0, f"a{i}", f"a{j}", float(np.linalg.norm(x[:, i] - x[:, j]))) for i in range(7) for j in range(i + 1, 7)]
    labels = spark.createDataFrame([(0, 3, f"a{i}", c) for i, c in enumerate(label)], "cv int, k int, asset string, label int")
    got = selection.cluster_inertias(spark.createDataFrame(rows, "cv int, a string, b string, d double"), labels, ["cv", "k"]).collect()
    groups = [[i for i, c in enumerate(label) if c == g] for g in range(3)]
    want = math.log(sum(np.mean([[np.linalg.norm(x[:, i] - x[:, j]) for i in g] for j in g]) for g in groups))
    assert len(got) == 1 and math.isclose(got[0]["inertia"], want, rel_tol=1e-9)


def planted(groups, seed=6, dates=120, each=4):
    rng = np.random.default_rng(seed)
    drivers = rng.normal(size=(dates, groups))
    return np.repeat(drivers, each, axis=1) + 0.15 * rng.normal(size=(dates, groups * each))


def test_gap_finds_planted_groups(spark):
    curve = selection.gap_statistic(frame(spark, planted(3)), range(1, 6), draws=6)
    rows = {r["k"]: r for r in curve.collect()}
    assert rows[3]["gap"] > rows[2]["gap"] + 0.5 and rows[3]["inertia"] < rows[2]["inertia"] - 0.5
    chosen = selection.chosen_by_gap(curve).first()
    assert chosen["first_gap"] == 3 and chosen["first_peak"] == 3


def test_gap_rules_on_a_given_curve(spark):
    curve = spark.createDataFrame([(0, 1, 0.0, 0.2, 0.01), (0, 2, 0.0, 0.5, 0.01), (0, 3, 0.0, 0.4, 0.01), (0, 4, 0.0, 0.6, 0.3), (1, 1, 0.0, 0.1, 0.0), (1, 2, 0.0, 0.2, 0.0)], "cv int, k int, inertia double, gap double, error double")
    got = {r["cv"]: (r["first_gap"], r["first_peak"]) for r in selection.chosen_by_gap(curve).collect()}
    assert got == {0: (2, 2), 1: (None, 2)}


def test_null_draws_do_not_depend_on_the_partitions(spark):
    rows = frame(spark, planted(2, dates=20))
    one = {(r["draw"], r["asset"], r["dt"]): r["r"] for r in selection.with_null_draws(rows, 3).collect()}
    two = {(r["draw"], r["asset"], r["dt"]): r["r"] for r in selection.with_null_draws(rows.repartition(7, "dt"), 3).collect()}
    assert one == two and len(one) == 4 * 20 * 8
    ends = {r["asset"]: (r["low"], r["high"]) for r in rows.groupBy("asset").agg(F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    assert all(ends[a][0] <= v <= ends[a][1] for (_, a, _), v in one.items())
    assert len(set(one.values())) > 0.95 * len(one)


def test_permuted_rows_are_those_of_the_plain_permutation(spark):
    from quantloom.functions.kernels import block_permutation

    rows = frame(spark, planted(1, dates=25, each=2))
    got = {}
    for r in selection.permuted_rows(rows, 12, 6).collect():
        got.setdefault(r["replicate"], {}).setdefault(r["asset"], []).append(r["dt"])
    possible = {tuple(sorted(block_permutation(25, 6, np.random.default_rng(i)))) for i in range(200)}
    assert len(got) == 12 and len({len(v) for r in got.values() for v in r.values()}) > 1
    assert all(tuple(sorted(v)) in possible for r in got.values() for v in r.values())


def test_silhouettes_equal_the_plain_ones(spark):
    from quantloom.functions.kernels import silhouette_score

    x, label = np.random.default_rng(5).normal(size=(30, 7)), [0, 0, 1, 1, 1, 2, 0]
    rows = frame(spark, x)
    labels = spark.createDataFrame([(0, k, f"a{i:02d}", c if k == 3 else 0) for k in (1, 3) for i, c in enumerate(label)], "cv int, k int, asset string, label int")
    got = {r["k"]: r["score"] for r in selection.silhouettes(selection.pair_distances(rows, ["cv"]), labels, ["cv", "k"]).collect()}
    d = np.linalg.norm(x.T[:, None] - x.T[None], axis=2)
    assert math.isclose(got[3], silhouette_score(d, np.array(label)), rel_tol=1e-9) and got[1] == 0


def test_silhouette_curve_finds_planted_groups(spark):
    curve = selection.silhouette_curve(frame(spark, planted(3)), range(2, 6), replicates=4, length=30)
    best = max(curve.collect(), key=lambda r: r["mean"])
    assert best["k"] == 3 and best["low"] <= best["mean"] <= best["high"]
    assert {r["rule"]: r["k"] for r in selection.chosen_by_band(curve).collect()}["max"] == 3


def test_band_rules_on_a_given_curve(spark):
    rows = [(0, k, m, m - w, m + w) for k, m, w in ((2, 0.30, 0.05), (3, 0.40, 0.02), (4, 0.35, 0.05), (5, 0.43, 0.2), (6, 0.41, 0.05), (7, 0.44, 0.06), (8, 0.2, 0.05))]
    got = {r["rule"]: r["k"] for r in selection.chosen_by_band(spark.createDataFrame(rows, "cv int, k int, mean double, low double, high double")).collect()}
    assert got == {"max": 7, "first_max": 3, "gap": 3, "extrema": 3}


def test_factors_of_shuffled_runs_are_matched(spark):
    rng = np.random.default_rng(8)
    own = np.abs(rng.normal(size=(6, 3))) * np.kron(np.eye(3), np.ones((2, 1)))
    rows = []
    for run in range(5):
        turn = rng.permutation(3)
        noisy = own + rng.normal(size=own.shape) * 1e-3
        rows += [(0, run, f"a{i}", int(k), float(noisy[i, turn[k]])) for i in range(6) for k in range(3)]
    loads = spark.createDataFrame(rows, "cv int, run int, asset string, factor int, loading double")
    matched = selection.matched_factors(loads)
    assert {(r["group"], r["n"]) for r in matched.groupBy("group").agg(F.countDistinct("run").alias("n")).collect()} == {(0, 5), (1, 5), (2, 5)}
    got = selection.averaged_loadings(loads, matched).toPandas().pivot(index="asset", columns="factor", values="loading").to_numpy()
    assert all(min(np.abs(got[:, k] - own[:, j]).max() for k in range(3)) < 5e-3 for j in range(3))


def test_runs_from_other_starts(spark):
    loads = selection.run_loadings(frame(spark, planted(3)), 3, 4).toPandas()
    assert loads.groupby(["run", "factor"]).size().eq(12).all() and loads["run"].nunique() == 4
    assert np.allclose((loads["loading"] ** 2).groupby([loads["run"], loads["factor"]]).sum(), 1)


def test_assignment_from_consensus(spark):
    from quantloom.operators.cluster import assigned

    shares = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.6), ("a", "d", 0.2), ("b", "b", 1.0), ("b", "d", 0.6), ("c", "c", 1.0), ("c", "d", 0.3), ("d", "d", 1.0)], "a string, b string, share double")
    names = spark.createDataFrame([("a",), ("d",)], "cluster string")
    got = {r["asset"]: (r["cluster"], r["share"]) for r in assigned(shares, names, 0.5).collect()}
    assert got == {"a": ("a", 1.0), "b": ("a", 0.6), "c": (None, None), "d": ("d", 1.0)}
