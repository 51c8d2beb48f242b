"""Minimisers and quadrature shared by the models (numpy only)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.1, most: int = 400, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """The point and value of ``settled_simplex``."""
    return settled_simplex(f, start, step, most, tol)[:2]


def settled_simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.1, most: int = 400, tol: float = 1e-8) -> tuple[np.ndarray, float, bool]:
    """Downhill simplex: reflect, expand, contract, shrink; whether the values met within ``tol`` before ``most`` steps."""
    n, settled = len(start), False
    points = np.vstack([start, *(start + step * (abs(start[i]) or 1.0) * np.eye(n)[i] for i in range(n))])
    values = np.array([f(p) for p in points])
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tol * (1 + abs(values[0])):
            settled = True
            break
        centre = points[:-1].mean(axis=0)

        def at(c: float) -> tuple[np.ndarray, float]:
            p = centre + c * (points[-1] - centre)
            return p, f(p)

        p, v = at(-1.0)
        if v < values[0]:
            q, w = at(-2.0)
            p, v = (q, w) if w < v else (p, v)
        elif v >= values[-2]:
            p, v = at(-0.5 if v < values[-1] else 0.5)
            if v >= values[-1]:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(x) for x in points[1:]]
                continue
        points[-1], values[-1] = p, v
    best = int(values.argmin())
    return points[best], float(values[best]), settled


def damped_least_squares(residuals: Callable[[np.ndarray], np.ndarray], start: np.ndarray, most: int = 80) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt with a forward-difference Jacobian."""
    x, damp = start.astype(float), 1e-3
    r = residuals(x)
    cost = float(r @ r)
    for _ in range(most):
        h = 1e-6 * np.maximum(1e-3, np.abs(x))
        jac = np.stack([(residuals(x + h[i] * np.eye(len(x))[i]) - r) / h[i] for i in range(len(x))], axis=1)
        a, g = jac.T @ jac, jac.T @ r
        moved = False
        for _ in range(8):
            try:
                d = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            s = residuals(x + d)
            new = float(s @ s)
            if np.isfinite(new) and new < cost:
                gain = cost - new
                x, r, cost, damp, moved = x + d, s, new, max(damp / 5, 1e-12), gain > 1e-14 * (1 + cost)
                break
            damp *= 4
        if not moved:
            break
    return x, cost


def norm_cdf(x: np.ndarray) -> np.ndarray:
    """Normal distribution through the complementary error function's Chebyshev fit (error under 1.2e-7)."""
    z = np.abs(np.asarray(x, float)) / np.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    #: The ten coefficients of that fit.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    tail = 0.5 * t * np.exp(-z * z + np.polyval(c[::-1], t))
    return np.where(np.asarray(x) >= 0, 1 - tail, tail)


def black_scholes(s: float, k: np.ndarray, t: float, sigma: np.ndarray, r: float = 0.0, q: float = 0.0) -> np.ndarray:
    """Call prices."""
    root = sigma * np.sqrt(t)
    d1 = (np.log(s / k) + (r - q) * t) / root + root / 2
    return s * np.exp(-q * t) * norm_cdf(d1) - k * np.exp(-r * t) * norm_cdf(d1 - root)


def implied_volatility(price: np.ndarray, s: float, k: np.ndarray, t: float, r: float = 0.0, q: float = 0.0) -> np.ndarray:
    """Bisection on [1e-4, 5] for all strikes at once; NaN outside the no-arbitrage bounds."""
    lo, hi = np.full(len(k), 1e-4), np.full(len(k), 5.0)
    inside = (price > black_scholes(s, k, t, lo, r, q)) & (price < black_scholes(s, k, t, hi, r, q))
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        low = black_scholes(s, k, t, mid, r, q) < price
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return np.where(inside, 0.5 * (lo + hi), np.nan)
