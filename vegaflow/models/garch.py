"""Conditional-variance models: one recursion each, one likelihood and one fit for all.

A model is a function (theta, returns, start variance) -> variances, with start
parameters and a box. The fit minimises the Gaussian likelihood by a simplex;
parameters outside the box cost a penalty.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable

import numpy as np
import pandas as pd

from vegaflow.models.optimise import settled_simplex

FLOOR, CAP = 1e-10, 1e6
#: A fit has settled when the likelihoods of its simplex differ by less, relatively.
FIT_TOL = 1e-10


@dataclasses.dataclass(frozen=True)
class Model:
    variances: Callable[[np.ndarray, np.ndarray, float], np.ndarray]
    start: Callable[[float], tuple[float, ...]]  # from the sample variance
    low: tuple[float, ...]
    high: tuple[float, ...]
    persistence: Callable[[np.ndarray], float]
    mean: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def walk(step: Callable[[float, float], float]) -> Callable[[np.ndarray, float], np.ndarray]:
    """Variances from a one-step rule (previous return, previous variance) -> variance."""

    def run(e: np.ndarray, h0: float) -> np.ndarray:
        out, h = [h0], h0
        for x in e[:-1].tolist():
            h = min(CAP, max(FLOOR, step(x, h)))
            out.append(h)
        return np.array(out)

    return run


def garch(p, e, h0):
    w, a, b = p
    return walk(lambda x, h: w + a * x * x + b * h)(e, h0)


def igarch(p, e, h0):
    w, a = p
    return walk(lambda x, h: w + a * x * x + (1 - a) * h)(e, h0)


def gjr(p, e, h0):
    w, a, g, b = p
    return walk(lambda x, h: w + (a + (g if x < 0 else 0.0)) * x * x + b * h)(e, h0)


def egarch(p, e, h0):
    w, a, g, b = p
    level = math.sqrt(2 / math.pi)

    def step(x, h):
        z = x / math.sqrt(h)
        return math.exp(min(13.0, max(-23.0, w + a * (abs(z) - level) + g * z + b * math.log(h))))

    return walk(step)(e, h0)


def tgarch(p, e, h0):
    w, a, g, b = p
    return walk(lambda x, h: (w + a * abs(x) - g * x + b * math.sqrt(h)) ** 2)(e, h0)


def avgarch(p, e, h0):
    w, a, b = p
    return walk(lambda x, h: (w + a * abs(x) + b * math.sqrt(h)) ** 2)(e, h0)


def aparch(p, e, h0):
    w, a, g, b, d = p
    return walk(lambda x, h: (w + a * max(1e-12, abs(x) - g * x) ** d + b * h ** (d / 2)) ** (2 / d))(e, h0)


def ngarch(p, e, h0):
    w, a, b, d = p
    return walk(lambda x, h: (w + a * abs(x) ** d + b * h ** (d / 2)) ** (2 / d))(e, h0)


def nagarch(p, e, h0):
    w, a, th, b = p
    return walk(lambda x, h: w + a * (x - th * math.sqrt(h)) ** 2 + b * h)(e, h0)


def cgarch(p, e, h0):
    """A slow and a fast component."""
    w, rho, phi, a, b = p
    out, q, h = [h0], h0, h0
    for y in (e[:-1] ** 2).tolist():
        q_next = w + rho * (q - w) + phi * (y - h)
        h = q_next + a * (y - q) + b * (h - q)
        h = FLOOR if h < FLOOR else CAP if h > CAP else h
        q = FLOOR if q_next < FLOOR else CAP if q_next > CAP else q_next
        out.append(h)
    return np.array(out)


def gas(p, e, h0):
    """Log variance moved by the scaled score."""
    w, a, b = p
    return walk(lambda x, h: math.exp(min(13.0, max(-23.0, w + b * math.log(h) + a * (x * x / h - 1)))))(e, h0)


def fractional_weights(d: float, phi: float, beta: float, lags: int) -> np.ndarray:
    """Weights of past squares in a fractionally integrated model."""
    delta, out = [d], [phi - beta + d]
    for k in range(2, lags + 1):
        delta.append(delta[-1] * (k - 1 - d) / k)
        out.append(beta * out[-1] + delta[-1] - phi * delta[-2])
    return np.maximum(np.array(out), 0)


def figarch(p, e, h0, lags=500):
    w, phi, d, b = p
    weights = fractional_weights(d, phi, b, min(lags, len(e)))
    squares = np.concatenate([np.full(len(weights), h0), e * e])
    past = np.convolve(squares, weights)[len(weights) - 1 : len(weights) - 1 + len(e)]
    return np.clip(w / (1 - b) + past, FLOOR, CAP)


def hygarch(p, e, h0):
    w, phi, d, b, mix, a = p
    return mix * figarch((w, phi, d, b), e, h0) + (1 - mix) * garch((w, a, b), e, h0)


def ms_garch(p, e, h0):
    """Two regimes with collapsed variance: the mixture by filtered regime probabilities."""
    w1, a1, b1, w2, a2, b2, stay1, stay2 = p
    out, h, q, exp = [h0], h0, 0.5, math.exp
    for y in (e[:-1] ** 2).tolist():
        v1, v2 = w1 + a1 * y + b1 * h, w2 + a2 * y + b2 * h
        v1, v2 = v1 if v1 > FLOOR else FLOOR, v2 if v2 > FLOOR else FLOOR
        f1, f2 = q * exp(-0.5 * y / v1) / v1**0.5, (1 - q) * exp(-0.5 * y / v2) / v2**0.5
        q = f1 / (f1 + f2) if f1 + f2 > 1e-300 else f1 / 1e-300
        q = q * stay1 + (1 - q) * (1 - stay2)
        h = q * v1 + (1 - q) * v2
        h = h if h < CAP else CAP
        out.append(h)
    return np.array(out)


def proxy(e: np.ndarray, width: int = 5) -> np.ndarray:
    """Mean of the last squares, fewer at the start."""
    c = np.concatenate([[0.0], np.cumsum(e * e)])
    i = np.arange(1, len(e) + 1)
    return (c[i] - c[np.maximum(0, i - width)]) / np.minimum(i, width)


def realized(p, e, h0):
    w, a, b = p
    x = proxy(e)
    out, h = [h0], h0
    for m in x[:-1].tolist():
        h = min(CAP, max(FLOOR, w + a * m + b * h))
        out.append(h)
    return np.array(out)


def _box(*pairs):
    return tuple(a for a, _ in pairs), tuple(b for _, b in pairs)


W, A, B, G = (1e-9, 1e3), (0.0, 0.6), (0.0, 0.999), (-0.5, 1.0)
total = lambda *at: lambda p: float(sum(p[i] for i in at))
MODELS: dict[str, Model] = {
    "GARCH": Model(garch, lambda v: (0.05 * v, 0.08, 0.87), *_box(W, A, B), total(1, 2)),
    "IGARCH": Model(igarch, lambda v: (0.01 * v, 0.06), *_box(W, (0.0, 0.999)), lambda p: 0.99),
    "GJR": Model(gjr, lambda v: (0.05 * v, 0.05, 0.06, 0.86), *_box(W, A, G, B), lambda p: p[1] + 0.5 * p[2] + p[3]),
    "EGARCH": Model(egarch, lambda v: (0.05 * math.log(v), 0.12, -0.05, 0.95), *_box((-20, 20), (-1, 1), (-1, 1), (-0.999, 0.999)), lambda p: abs(p[3])),
    "TGARCH": Model(tgarch, lambda v: (0.05 * math.sqrt(v), 0.08, 0.02, 0.88), *_box(W, A, (-0.5, 0.5), B), lambda p: p[1] * 0.8 + p[3]),
    "AVGARCH": Model(avgarch, lambda v: (0.05 * math.sqrt(v), 0.08, 0.88), *_box(W, A, B), lambda p: p[1] * 0.8 + p[2]),
    "APARCH": Model(aparch, lambda v: (0.05 * v, 0.07, 0.1, 0.87, 1.7), *_box(W, A, (-0.95, 0.95), B, (0.5, 3.0)), total(1, 3)),
    "NGARCH": Model(ngarch, lambda v: (0.05 * v, 0.07, 0.87, 1.7), *_box(W, A, B, (0.5, 3.0)), total(1, 2)),
    "NAGARCH": Model(nagarch, lambda v: (0.05 * v, 0.06, 0.3, 0.85), *_box(W, A, (-3, 3), B), lambda p: p[1] * (1 + p[2] ** 2) + p[3]),
    "CGARCH": Model(cgarch, lambda v: (v, 0.99, 0.03, 0.06, 0.8), *_box(W, (0.8, 0.9999), (0, 0.5), A, B), lambda p: max(p[1], p[3] + p[4])),
    "GAS": Model(gas, lambda v: (0.05 * math.log(v), 0.08, 0.95), *_box((-20, 20), (0, 0.5), (0, 0.999)), lambda p: p[2]),
    "FIGARCH": Model(figarch, lambda v: (0.05 * v, 0.2, 0.4, 0.5), *_box(W, (0, 0.9), (0.01, 0.99), (0, 0.95)), lambda p: 0.99),
    "HYGARCH": Model(hygarch, lambda v: (0.05 * v, 0.2, 0.4, 0.5, 0.5, 0.1), *_box(W, (0, 0.9), (0.01, 0.99), (0, 0.95), (0, 1), A), lambda p: 0.99),
    "MS-GARCH": Model(ms_garch, lambda v: (0.02 * v, 0.05, 0.85, 0.2 * v, 0.1, 0.85, 0.97, 0.95), *_box(W, A, B, W, A, B, (0.5, 0.999), (0.5, 0.999)), lambda p: max(p[1] + p[2], p[4] + p[5])),
    "REALIZED": Model(realized, lambda v: (0.05 * v, 0.3, 0.65), *_box(W, (0, 0.9), B), total(1, 2)),
    "HEAVY": Model(realized, lambda v: (0.05 * v, 0.2, 0.75), *_box(W, (0, 0.5), B), total(1, 2)),
    "GARCH-M": Model(lambda p, e, h0: garch(p[:3], e, h0), lambda v: (0.05 * v, 0.08, 0.87, 0.0, 0.0), *_box(W, A, B, (-1, 1), (-1, 1)), total(1, 2), mean=lambda p, h: p[3] + p[4] * np.sqrt(h)),
}


def likelihood(model: Model, theta: np.ndarray, x: np.ndarray, h0: float) -> float:
    """Negative Gaussian log likelihood, with a penalty outside the box and beyond stationarity."""
    low, high = np.array(model.low), np.array(model.high)
    inside = np.clip(theta, low, high)
    cost = 1e4 * float(np.abs(theta - inside).sum())
    over = model.persistence(inside) - 0.9995
    cost += 1e5 * max(0.0, over)
    h = model.variances(inside, x, h0)
    e = x - model.mean(inside, h) if model.mean else x
    v = 0.5 * float(np.sum(np.log(2 * np.pi * h) + e * e / h))
    return v + cost if math.isfinite(v) else 1e12


#: Models whose variance is linear in the squared return, whatever its sign: expected squares stand in for returns to come.
LINEAR = ("GARCH", "IGARCH", "CGARCH", "FIGARCH", "HYGARCH", "REALIZED", "GARCH-M")
#: Reported persistence of models that never forget a shock.
INTEGRATED = ("IGARCH", "FIGARCH")
PATHS = 400


def ahead(name: str, theta: np.ndarray, x: np.ndarray, h0: float, days: int = 20) -> np.ndarray:
    """Expected variances of the next days under the model's own dynamics.

    Linear models run on with expected squares; GJR as well, with half of its
    asymmetry; HEAVY takes the measure to follow its variance; all others are the
    mean of simulated paths of one seed.
    """
    model = MODELS[name]
    h = float(model.variances(theta, np.append(x, 0.0), h0)[-1])
    out = [h]
    if name == "GJR":
        w, a, g, b = theta
        while len(out) < days:
            out.append(w + (a + g / 2 + b) * out[-1])
    elif name == "HEAVY":
        w, a, b = theta
        while len(out) < days:
            out.append(w + (a + b) * out[-1])
    elif name in LINEAR:
        run = x
        while len(out) < days:
            run = np.append(run, math.sqrt(out[-1]))
            out.append(float(model.variances(theta, np.append(run, 0.0), h0)[-1]))
    else:
        rng, sums = np.random.default_rng(97), np.zeros(days)
        for z in rng.normal(size=(PATHS, days)):
            path, v = [], h
            sums[0] += h
            for d in range(1, days):
                path.append(math.sqrt(v) * z[d])
                v = float(model.variances(theta, np.array([*path, 0.0]), h)[-1])
                sums[d] += v
        return sums / PATHS
    return np.array(out)


def fit(name: str, returns: np.ndarray, most: int = 4000) -> dict:
    """Parameters, information criteria and the 1- and 20-day variance forecasts of demeaned returns (in percent)."""
    model, x = MODELS[name], returns - returns.mean()
    h0 = float(x.var()) or 1e-8
    start = np.array(model.start(h0))
    theta, cost, settled = settled_simplex(lambda p: likelihood(model, p, x, h0), start, most=most, tol=FIT_TOL)
    theta = np.clip(theta, model.low, model.high)
    later = ahead(name, theta, x, h0)
    k, n = len(theta), len(x)
    keep = 1.0 if name in INTEGRATED else max(0.0, model.persistence(theta))
    return {"model": name, "k": k, "n": n, "nll": cost, "aic": 2 * k + 2 * cost, "bic": k * math.log(n) + 2 * cost, "persistence": keep, "sigma_1d": math.sqrt(later[0] * 252), "sigma_20d": math.sqrt(max(0.0, later.mean()) * 252), "converged": settled}


#: Models of two series.
PAIRS = ("CCC", "DCC", "BEKK", "OGARCH")


def diagonal_bekk(e: np.ndarray) -> dict:
    """Covariances by own and cross products with diagonal weights, around the sample covariance (variance targeting)."""
    target = e @ e.T / e.shape[1]
    flat = target[[0, 0, 1], [0, 1, 1]]
    products = np.stack([e[0] * e[0], e[0] * e[1], e[1] * e[1]], axis=1)

    def path(p: np.ndarray) -> np.ndarray:
        a, b = np.abs(p[:2]), np.abs(p[2:])
        news, memory = np.array([a[0] ** 2, a[0] * a[1], a[1] ** 2]), np.array([b[0] ** 2, b[0] * b[1], b[1] ** 2])
        base, h, out = (1 - news - memory) * flat, flat.copy(), []
        for x in products:
            out.append(h)
            h = base + news * x + memory * h
        return np.array([*out, h])

    def cost(p: np.ndarray) -> float:
        over = max(0.0, float((np.abs(p[:2]) ** 2 + np.abs(p[2:]) ** 2).max()) - 0.9995)
        if over:
            return 1e8 * (1 + over)
        h = path(p)[:-1]
        det = h[:, 0] * h[:, 2] - h[:, 1] ** 2
        if not (det > 0).all():
            return 1e8
        return 0.5 * float(np.sum(2 * math.log(2 * math.pi) + np.log(det) + (h[:, 2] * products[:, 0] - 2 * h[:, 1] * products[:, 1] + h[:, 0] * products[:, 2]) / det))

    p, v, settled = settled_simplex(cost, np.array([0.2, 0.2, 0.95, 0.95]), most=4000, tol=FIT_TOL)
    last = path(p)[-1]
    return {"model": "BEKK", "k": 7, "nll": v, "correlation": float(last[1] / math.sqrt(last[0] * last[2])), "converged": settled}


def orthogonal_garch(e: np.ndarray) -> dict:
    """Principal components with a variance model each; the correlation that they imply for the next day."""
    _, vectors = np.linalg.eigh(e @ e.T / e.shape[1])
    nll, next_variances, all_settled = 0.0, [], True
    for f in vectors.T @ e:
        h0 = float(f.var())
        theta, v, settled = settled_simplex(lambda p, f=f, h0=h0: likelihood(MODELS["GARCH"], p, f, h0), np.array(MODELS["GARCH"].start(h0)), most=4000, tol=FIT_TOL)
        theta = np.clip(theta, MODELS["GARCH"].low, MODELS["GARCH"].high)
        nll, all_settled = nll + v, all_settled and settled
        next_variances.append(float(garch(theta, np.append(f, 0.0), h0)[-1]))
    h = vectors @ np.diag(next_variances) @ vectors.T
    return {"model": "OGARCH", "k": 6, "nll": nll, "correlation": float(h[0, 1] / math.sqrt(h[0, 0] * h[1, 1])), "converged": all_settled}


def correlations(pdf: pd.DataFrame, kind: str) -> dict:
    """Correlation of two series: constant or dynamic, standardised by their own GARCH variances, or of a model of both."""
    if kind in ("BEKK", "OGARCH"):
        e = pdf[["x", "y"]].to_numpy().T
        return (diagonal_bekk if kind == "BEKK" else orthogonal_garch)(e - e.mean(axis=1, keepdims=True))
    z, all_settled = [], True
    for c in ("x", "y"):
        e = pdf[c].to_numpy() - pdf[c].mean()
        h0 = float(e.var())
        theta, _, settled = settled_simplex(lambda p, e=e, h0=h0: likelihood(MODELS["GARCH"], p, e, h0), np.array(MODELS["GARCH"].start(h0)), most=4000, tol=FIT_TOL)
        all_settled &= settled
        z.append(e / np.sqrt(garch(np.clip(theta, MODELS["GARCH"].low, MODELS["GARCH"].high), e, h0)))
    z = np.stack(z)
    flat = float(np.corrcoef(z)[0, 1])

    def path(a: float, b: float) -> np.ndarray:
        q = np.array([1.0, flat, 1.0])
        base, out = q.copy(), []
        for i in range(z.shape[1]):
            out.append(q[1] / math.sqrt(q[0] * q[2]))
            q = (1 - a - b) * base + a * np.array([z[0, i] ** 2, z[0, i] * z[1, i], z[1, i] ** 2]) + b * q
        return np.clip(np.array(out), -0.9999, 0.9999)

    def cost(rho: np.ndarray) -> float:
        one = 1 - rho * rho
        return 0.5 * float(np.sum(np.log(one) + (z[0] ** 2 + z[1] ** 2 - 2 * rho * z[0] * z[1]) / one))

    if kind == "CCC":
        return {"model": "CCC", "k": 7, "nll": cost(np.full(z.shape[1], flat)), "correlation": flat, "converged": all_settled}
    free = lambda p: cost(path(*np.clip(p, 0, 0.995))) + 1e5 * max(0.0, float(np.clip(p, 0, 0.995).sum()) - 0.995)
    p, v, settled = settled_simplex(free, np.array([0.03, 0.9]), most=4000, tol=FIT_TOL)
    return {"model": "DCC", "k": 8, "nll": v, "correlation": float(path(*np.clip(p, 0, 0.995))[-1]), "converged": all_settled and settled}
