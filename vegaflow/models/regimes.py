"""Regime models of a return series: mixtures, Markov switching, clusters of distributions."""

from __future__ import annotations

import math

import numpy as np


def normal(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(n, k) densities."""
    return np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * math.pi * var)


def gaussian_mixture(x: np.ndarray, rounds: int = 300, tol: float = 1e-8) -> dict:
    """Two components by expectation-maximisation, calm one first, and the criterion against one component."""
    mean, var, w = np.array([x.mean(), x.mean()]), np.array([0.5, 2.0]) * x.var(), np.array([0.7, 0.3])
    last, trace = -np.inf, []
    for _ in range(rounds):
        p = w * normal(x, mean, var)
        total = np.maximum(p.sum(axis=1), 1e-300)
        trace.append(float(np.log(total).sum()))
        r = p / total[:, None]
        n = r.sum(axis=0)
        w, mean = n / len(x), (r * x[:, None]).sum(axis=0) / n
        var = np.maximum((r * (x[:, None] - mean) ** 2).sum(axis=0) / n, 1e-12)
        if trace[-1] - last < tol * (1 + abs(trace[-1])):
            break
        last = trace[-1]
    order = np.argsort(var)
    single = float(np.log(np.maximum(normal(x, np.array([x.mean()]), np.array([x.var()]))[:, 0], 1e-300)).sum())
    bic = lambda ll, k: k * math.log(len(x)) - 2 * ll
    return {"weight": w[order], "mean": mean[order], "sd": np.sqrt(var[order]), "trace": trace, "bic_two": bic(trace[-1], 5), "bic_one": bic(single, 2), "rounds": len(trace)}


def markov_switching(x: np.ndarray, rounds: int = 100, tol: float = 1e-7) -> dict:
    """Two states by EM with the forward filter and the backward smoother; calm state first."""
    mean, var = np.full(2, x.mean()), np.array([0.5, 2.0]) * x.var()
    move, first, trace = np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([0.5, 0.5]), []
    smooth = np.zeros((len(x), 2))
    for _ in range(rounds):
        like = np.maximum(normal(x, mean, var), 1e-300)
        seen, guess = np.empty_like(like), np.empty_like(like)
        ll, p = 0.0, first
        for t in range(len(x)):
            guess[t] = p
            joint = p * like[t]
            s = joint.sum()
            ll += math.log(s)
            seen[t] = joint / s
            p = seen[t] @ move
        smooth[-1] = seen[-1]
        pairs = np.zeros((2, 2))
        for t in range(len(x) - 2, -1, -1):
            ratio = smooth[t + 1] / np.maximum(guess[t + 1], 1e-300)
            both = seen[t][:, None] * move * ratio
            pairs += both
            smooth[t] = both.sum(axis=1)
        move = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1e-300)
        n = smooth.sum(axis=0)
        mean = (smooth * x[:, None]).sum(axis=0) / n
        var = np.maximum((smooth * (x[:, None] - mean) ** 2).sum(axis=0) / n, 1e-12)
        first = smooth[0]
        trace.append(ll)
        if len(trace) > 1 and trace[-1] - trace[-2] < tol * (1 + abs(ll)):
            break
    order = np.argsort(var)
    return {"mean": mean[order], "sd": np.sqrt(var[order]), "stay": np.diag(move)[order], "calm_now": float(smooth[-1, order[0]]), "trace": trace}


#: Random numbers by which the first centres are drawn, the same for every series.
DRAWS = tuple(np.random.default_rng(7).random(3).tolist())


def wasserstein_clusters(x: np.ndarray, width: int = 20, draws: tuple[float, ...] = DRAWS, rounds: int = 50) -> dict:
    """k-means of sliding windows as sorted samples: the squared distance is that of quantile functions."""
    windows = np.sort(np.lib.stride_tricks.sliding_window_view(x, width), axis=1)
    k, centres = len(draws), windows[[int(draws[0] * len(windows))]]
    for draw in draws[1:]:
        d = ((windows[:, None] - centres) ** 2).mean(axis=2).min(axis=1).cumsum()
        centres = np.vstack([centres, windows[int(np.searchsorted(d, draw * d[-1], "right"))]])
    for _ in range(rounds):
        near = ((windows[:, None] - centres) ** 2).mean(axis=2).argmin(axis=1)
        new = np.stack([windows[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    spread = centres.std(axis=1)
    order = np.argsort(spread)
    place = np.argsort(order)
    return {"sd": spread[order], "share": np.bincount(place[near], minlength=k) / len(near), "now": int(place[near[-1]])}
