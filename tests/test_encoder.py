"""The encoder: slopes by differences, planted factors, stopping, and joins against the network itself."""

import numpy as np
import pytest

from quantloom.functions.encoder import Encoder, forward, intercepts, linear_part, train, unit_norm, warm_start
from quantloom.operators.encoder import averaged_predictions, fold_encoders, linear_activations, prediction_quality, predictions


def planted(seed=1, dates=240, each=4):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(dates, 2)), each, axis=1) + 0.3 * rng.normal(size=(dates, 2 * each))
    return (x - x.mean(0)) / x.std(0)


def test_slopes_equal_differences():
    x, s, rng = planted()[:50], Encoder(k=3, decorrelate=0.5, orthogonal=0.3, absolute=0.02), np.random.default_rng(2)
    w = {k: v + 0.05 * rng.random(v.shape) for k, v in warm_start(x, 3, 0, 1e-3).items()}
    slopes = forward(x, w, s, True)[2]
    for name, slope in slopes.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w[name].shape)
            ends = []
            for h in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += h
                ends.append(sum(forward(x, moved, s, True)[:2]))
            assert abs((ends[0] - ends[1]) / 2e-6 - slope[at]) < 1e-5


def test_projection():
    w = unit_norm(np.array([[3.0, -1], [0.5, -2]]), 0)
    assert np.allclose(w, [[2 / np.sqrt(5), 0], [1 / np.sqrt(5), 0]], atol=1e-6)


def test_planted_factors_are_found_and_the_best_epoch_is_kept():
    x = planted()
    found = train(x[:180], x[180:], Encoder(k=2, epochs=150))
    w = found.weights
    assert (w["w1"] >= 0).all() and np.allclose(np.linalg.norm(w["w1"], axis=0), 1, atol=1e-5) and np.allclose(np.linalg.norm(w["w2"], axis=1), 1, atol=1e-5)
    groups = w["w2"].T.argmax(1)
    assert len(set(groups[:4])) == len(set(groups[4:])) == 1 and groups[0] != groups[4]
    s = Encoder(k=2)
    assert np.isclose(sum(forward(x[180:], w, s, False)[:2]), min(found.losses)) and found.losses[found.best] == min(found.losses)
    assert sum(forward(x[180:], w, s, False)[:2]) < sum(forward(x[180:], warm_start(x[:180], 2, 0, 1e-3), s, False)[:2])


def test_it_stops_when_nothing_is_gained():
    x = planted()
    found = train(x[:180], x[180:], Encoder(k=2, epochs=500, patience=10, gain=0.05))
    assert len(found.losses) < 200


def test_linear_part_and_intercept():
    x, s = planted(), Encoder(k=2, epochs=20)
    w = train(x[:180], x[180:], s).weights
    coefficient, constant, boundary = linear_part(w, s.epsilon)
    a = x @ w["w1"] + w["b1"]
    sd = np.sqrt(w["var"] + s.epsilon)
    assert np.allclose(x @ coefficient + constant, w["gamma"] * (a - w["mean"]) / sd + w["beta"])
    assert np.allclose(boundary, w["gamma"] * (0 - w["mean"]) / sd + w["beta"])
    zero = boundary @ w["w2"] + w["b2"]
    assert np.allclose(intercepts(w, s.epsilon, np.full(8, 0.1), np.full(8, 2.0)), zero * 2 + 0.1)


def test_joins_give_what_the_network_gives(spark):
    x, names, settings = planted(), [f"a{j}" for j in range(8)], Encoder(k=2, epochs=30)
    split = ["train"] * 180 + ["val"] * 40 + ["test"] * 20
    rows = [(0, split[t], names[j], t, float(x[t, j])) for t in range(240) for j in range(8)]
    scaled = spark.createDataFrame(rows, "cv int, split string, asset string, dt int, z double")
    scaler = spark.createDataFrame([(0, n, 0.01 * j, 0.5 + j) for j, n in enumerate(names)], "cv int, asset string, m double, s double")
    encoders = fold_encoders(scaled, scaler, settings, runs=2).persist()
    activations = linear_activations(scaled, encoders)
    fits = predictions(activations, encoders, scaler)
    mean, sd = 0.01 * np.arange(8), 0.5 + np.arange(8)
    total = np.zeros((240, 8))
    for run in range(2):
        w = train(x[:180], x[180:220], Encoder(**{**settings.__dict__, "seed": run})).weights
        h = np.maximum(x @ w["w1"] + w["b1"], 0)
        z = w["gamma"] * (h - w["mean"]) / np.sqrt(w["var"] + settings.epsilon) + w["beta"]
        made = (z @ w["w2"] + w["b2"]) * sd + mean
        total += made / 2
        got = fits.where(f"run = {run}").toPandas().pivot(index="dt", columns="asset", values="fit").to_numpy()
        assert np.allclose(got, made, atol=1e-8)
        events = activations.where(f"run = {run}").toPandas().pivot(index="dt", columns="factor", values="event").to_numpy()
        assert (events == (x @ w["w1"] + w["b1"] <= 1e-12)).mean() > 0.999
    returns = spark.createDataFrame([(0, split[t], names[j], t, float(x[t, j] * sd[j] + mean[j])) for t in range(240) for j in range(8)], "cv int, split string, asset string, dt int, r double")
    quality = {r["split"]: r for r in prediction_quality(averaged_predictions(fits, returns)).collect()}
    truth = x * sd + mean
    for name, part in (("train", slice(0, 180)), ("test", slice(220, 240))):
        e = truth[part] - total[part]
        assert np.isclose(quality[name]["r2"], 1 - (e**2).sum() / (truth[part] ** 2).sum()) and np.isclose(quality[name]["rmse"], np.sqrt((e**2).mean()))


@pytest.mark.parametrize("few", [1, 2])
def test_too_few_assets_or_dates(spark, few):
    rows = [(0, "train", f"a{j}", t, 0.1 * t) for t in range(2 if few == 1 else 9) for j in range(5 if few == 1 else 2)]
    scaled = spark.createDataFrame(rows, "cv int, split string, asset string, dt int, z double")
    scaler = scaled.selectExpr("cv", "asset", "0D AS m", "1D AS s").distinct()
    assert fold_encoders(scaled, scaler).count() == 0
