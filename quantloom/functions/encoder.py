"""A one-layer encoder of returns with non-negative unit-norm weights, trained by minibatches; numpy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .kernels import block_permutation, convex_factors, nearest_groups

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Encoder:
    """Settings of the encoder: ``k`` rectified units, their batch normalisation, a penalty on the units' covariances, one on
    decoder rows that are not orthogonal, one on the decoder's size, and how it is trained."""

    k: int = 4
    decorrelate: float = 1e-2
    orthogonal: float = 1e-2
    absolute: float = 1e-3
    rate: float = 1e-2
    epochs: int = 400
    batch: int = 128
    block: int = 12
    patience: int = 60
    gain: float = 1e-4
    momentum: float = 0.9
    epsilon: float = 1e-3
    seed: int = 0


def unit_norm(w: np.ndarray, axis: int, top: float = 1.0) -> np.ndarray:
    """Weights cut to 0 .. ``top`` and of length one along an axis; where nothing is left it stays zero."""
    w = np.clip(w, 0, top)
    return w / (1e-7 + np.linalg.norm(w, axis=axis, keepdims=True))


def warm_start(x: np.ndarray, k: int, seed: int, epsilon: float) -> Weights:
    """Weights from convex factors: the encoder from their mixes, the decoder from their loadings, neither with zeros, and
    an output bias that makes up for the means."""
    gram = x.T @ x
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    mix, loading, _ = convex_factors(gram, nearest_groups(gram / np.outer(scale, scale), k, seed), k)
    first = (mix + 0.2) ** 2
    out = {"w1": unit_norm(first / first.sum(0), 0), "b1": np.zeros(k), "gamma": np.ones(k), "beta": np.zeros(k), "w2": unit_norm((loading + 0.2).T, 1), "b2": x.mean(0) - (x @ mix @ loading.T).mean(0)}
    h = np.maximum(x @ out["w1"], 0)
    return out | {"mean": h.mean(0), "var": h.var(0)}


def forward(x: np.ndarray, w: Weights, s: Encoder, training: bool) -> tuple[float, float, Weights, tuple[np.ndarray, np.ndarray]]:
    """(squared error, penalties, slopes, moments): of a batch, with its own moments of the units in training and the known
    ones otherwise; slopes are empty then."""
    n, m = x.shape
    a = x @ w["w1"] + w["b1"]
    h = np.maximum(a, 0)
    mean, var = (h.mean(0), h.var(0)) if training else (w["mean"], w["var"])
    sd = np.sqrt(var + s.epsilon)
    u = (h - mean) / sd
    z = w["gamma"] * u + w["beta"]
    off = z @ w["w2"] + w["b2"] - x
    centred = z - z.mean(0)
    cov = centred.T @ centred / n
    cov[np.diag_indices(len(cov))] = 0
    gram = w["w2"] @ w["w2"].T - np.eye(len(w["w2"]))
    far = np.sqrt((gram**2).sum())
    error = float((off**2).mean())
    penalty = float(s.decorrelate * (cov**2).sum() / 2 + s.orthogonal * far + s.absolute * np.abs(w["w2"]).sum())
    if not training:
        return error, penalty, {}, (mean, var)
    back = 2 * off / (n * m)
    slopes = {"w2": z.T @ back + s.orthogonal * 2 * gram @ w["w2"] / max(far, 1e-12) + s.absolute * np.sign(w["w2"]), "b2": back.sum(0)}
    dz = back @ w["w2"].T + s.decorrelate * 2 / n * centred @ cov
    slopes |= {"gamma": (dz * u).sum(0), "beta": dz.sum(0)}
    du = dz * w["gamma"]
    da = (du - du.mean(0) - u * (du * u).mean(0)) / sd * (a > 0)
    return error, penalty, slopes | {"w1": x.T @ da, "b1": da.sum(0)}, (mean, var)


@dataclass
class Trained:
    """Weights of the best epoch, by the loss on validation rows, and the losses of all epochs."""

    weights: Weights
    best: int
    losses: list[float] = field(default_factory=list)


def train(x: np.ndarray, check: np.ndarray, s: Encoder) -> Trained:
    """The encoder of the rows ``x``, all columns standardised: steps of Adam on minibatches of rows that are put in another
    order in each epoch by whole blocks, weights put back to non-negative ones of length one after each. It stops
    once the loss on ``check`` has not become less, by ``gain``, than any of the last ``patience`` losses, and the best
    epoch's weights are returned. Without rows to check the loss is that of ``x``."""
    rng, check = np.random.default_rng(s.seed), check if len(check) else x
    w = warm_start(x, s.k, s.seed, s.epsilon)
    moving = ("mean", "var")
    first, second = ({k: np.zeros_like(v) for k, v in w.items() if k not in moving} for _ in range(2))
    count = 0
    start = forward(check, w, s, False)
    out = Trained({k: v.copy() for k, v in w.items()}, -1, [])
    best = start[0] + start[1]
    for epoch in range(s.epochs):
        rows = x[block_permutation(len(x), s.block, rng)]
        for at in range(0, len(rows), s.batch):
            part = rows[at : at + s.batch]
            if len(part) < 2:
                continue
            _, _, slopes, (mean, var) = forward(part, w, s, True)
            count += 1
            for k, g in slopes.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - s.rate * (first[k] / (1 - 0.9**count)) / (np.sqrt(second[k] / (1 - 0.999**count)) + 1e-7)
            w["w1"], w["w2"] = unit_norm(w["w1"], 0), unit_norm(w["w2"], 1)
            w["mean"] = s.momentum * w["mean"] + (1 - s.momentum) * mean
            w["var"] = s.momentum * w["var"] + (1 - s.momentum) * var
        error, penalty, _, _ = forward(check, w, s, False)
        out.losses.append(error + penalty)
        if out.losses[-1] < best:
            best, out.best, out.weights = out.losses[-1], epoch, {k: v.copy() for k, v in w.items()}
        if epoch >= s.patience and out.losses[-1] >= max(out.losses[-1 - s.patience : -1]) - s.gain:
            break
    return out


def linear_part(w: Weights, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, constants, boundaries) of each unit before it is rectified, but normalised: its value is the
    standardised returns times the coefficients plus the constant, and it was cut where that is at the boundary."""
    scale = w["gamma"] / np.sqrt(w["var"] + epsilon)
    boundary = w["beta"] - scale * w["mean"]
    return w["w1"] * scale, w["b1"] * scale + boundary, boundary


def intercepts(w: Weights, epsilon: float, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Constant part of each asset's fitted return, in units of returns: what the decoder gives for rectified units of
    zero."""
    rest = w["beta"] - w["gamma"] * w["mean"] / np.sqrt(w["var"] + epsilon)
    return w["b2"] * sd + mean + sd * (rest @ w["w2"])
