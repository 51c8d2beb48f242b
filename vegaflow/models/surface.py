"""Smile and pricing models on one slice of strikes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from vegaflow.models.optimise import black_scholes, damped_least_squares, implied_volatility, settled_simplex


def svi(p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Raw parametrisation of total variance over log-moneyness."""
    a, b, rho, m, s = p
    return a + b * (rho * (k - m) + np.sqrt((k - m) ** 2 + s * s))


def fit_svi(k: np.ndarray, total: np.ndarray, weight: np.ndarray) -> dict | None:
    """Best of six damped least-squares fits; None under six samples."""
    if len(k) < 6:
        return None
    scale = np.sqrt(weight / weight.sum())

    def shape(z: np.ndarray) -> np.ndarray:  # free variables to admissible parameters
        return np.array([z[0], math.exp(min(5, z[1])), math.tanh(z[2]), z[3], math.exp(min(3, z[4]))])

    best = None
    for rho in (-0.7, -0.3, 0.0):
        for s in (0.1, 0.3):
            z0 = np.array([0.5 * total.min(), math.log(max(1e-3, np.ptp(total) / max(1e-6, np.ptp(k)))), math.atanh(rho), float(k[total.argmin()]), math.log(s)])
            z, cost = damped_least_squares(lambda z: scale * (svi(shape(z), k) - total), z0)
            if best is None or cost < best[1]:
                best = shape(z), cost
    p = best[0]
    grid = np.linspace(k.min() - 0.1, k.max() + 0.1, 81)
    return {"a": p[0], "b": p[1], "rho": p[2], "m": p[3], "sigma": p[4], "rmse": float(np.sqrt(np.mean((svi(p, k) - total) ** 2))), "butterfly_ok": bool((durrleman(p, grid) >= 0).all()), "floor_ok": bool(p[0] + p[1] * p[4] * math.sqrt(1 - p[2] ** 2) >= 0)}


def durrleman(p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The function whose sign tells butterfly arbitrage."""
    _, b, rho, m, s = p
    w, root = svi(p, k), np.sqrt((k - m) ** 2 + s * s)
    d1, d2 = b * (rho + (k - m) / root), b * s * s / root**3
    return (1 - k * d1 / (2 * w)) ** 2 - d1 * d1 / 4 * (1 / w + 0.25) + d2 / 2


def local_volatility_grid(t: np.ndarray, p: np.ndarray, rows: int = 32, columns: int = 64, half: float = 0.2) -> dict:
    """Local volatility and a flag on a grid of years (geometric) and log-moneyness (even), by fitted slices ``p`` at years ``t``.

    Total variance is linear in time between slices; cells without a value tell why.
    """
    order = np.argsort(t, kind="stable")
    t, p = t[order], p[order]
    years, y = np.geomspace(max(t[0], 7 / 365), max(t[-1], 7 / 365), rows), np.linspace(-half, half, columns)
    b, rho, m, s = (p[:, i, None] for i in range(1, 5))
    root = np.sqrt((y - m) ** 2 + s * s)
    at = np.stack([p[:, :1] + b * (rho * (y - m) + root), b * (rho + (y - m) / root), b * s * s / root**3])
    i = np.clip(np.searchsorted(t, years) - 1, 0, len(t) - 2)
    share = np.clip((years - t[i]) / (t[i + 1] - t[i]), 0, 1)[:, None]
    w, d1, d2 = (1 - share) * at[:, i] + share * at[:, i + 1]
    slope = (at[0, i + 1] - at[0, i]) / (t[i + 1] - t[i])[:, None]
    with np.errstate(all="ignore"):
        n = 1 - y / w * d1 + 0.25 * (-0.25 - 1 / w + y * y / (w * w)) * d1 * d1 + 0.5 * d2
        v = slope / n
    flag = np.select([~(w > 0), slope < 0, ~(n > 0), ~(v >= 1e-5)], ["w-nonpos", "calendar-arb", "butterfly-arb", "clipped"], "ok")
    years, y = np.broadcast_arrays(years[:, None], y)
    return {"t": years.ravel(), "y": y.ravel(), "local_vol": np.where(flag == "ok", np.sqrt(np.abs(v)), np.nan).ravel(), "flag": flag.ravel()}


#: Seeds (rho, eta, gamma) of the surface fit.
SSVI_SEEDS = ((-0.7, 1.5, 0.5), (-0.5, 1.0, 0.4), (-0.9, 2.0, 0.6), (-0.3, 1.0, 0.3), (-0.75, 1.2, 0.45))
SSVI_FIELDS = ("expirations", "rho", "eta", "gamma", "rmse_iv", "calendar_ok", "butterfly_most", "butterfly_ok", "converged")


def ssvi(theta: np.ndarray, k: np.ndarray, rho: float, eta: float, gamma: float) -> np.ndarray:
    """Total variance of the surface with the power-law curvature."""
    x = curvature(theta, eta, gamma) * k
    return theta / 2 * (1 + rho * x + np.sqrt((x + rho) ** 2 + 1 - rho * rho))


def curvature(theta: np.ndarray, eta: float, gamma: float) -> np.ndarray:
    return eta * theta**-gamma * (1 + theta) ** (gamma - 1)


def fit_ssvi(t: np.ndarray, k: np.ndarray, iv: np.ndarray) -> dict | None:
    """The surface of all quotes (years, log-moneyness, volatility); None without two expirations of five quotes.

    Variance at the money is interpolated within each expiration; the three
    other parameters minimise the squared error of volatility, from five seeds.
    """
    years = [x for x in np.unique(t) if (t == x).sum() >= 5]
    if len(years) < 2:
        return None
    keep = np.isin(t, years)
    t, k, iv = t[keep], k[keep], iv[keep]
    at = {}
    for x in years:
        order = np.argsort(k[t == x])
        at[x] = float(np.interp(0.0, k[t == x][order], iv[t == x][order])) ** 2 * x
    theta = np.array([at[x] for x in t])
    shape = lambda z: (math.tanh(z[0]), math.exp(min(5.0, z[1])), 1 / (1 + math.exp(-z[2])))
    error = lambda z: float(np.mean((np.sqrt(np.maximum(ssvi(theta, k, *shape(z)), 0) / t) - iv) ** 2))
    fits = [settled_simplex(error, np.array([math.atanh(rho), math.log(eta), math.log(gamma / (1 - gamma))])) for rho, eta, gamma in SSVI_SEEDS]
    z, cost, settled = min(fits, key=lambda f: f[1])
    rho, eta, gamma = shape(z)
    levels = np.array([at[x] for x in years])
    most = float((levels * curvature(levels, eta, gamma)).max() * (1 + abs(rho)))
    return dict(zip(SSVI_FIELDS, (len(years), rho, eta, gamma, math.sqrt(cost), bool((np.diff(levels) >= -1e-10).all()), most, most <= 4 + 1e-6, settled), strict=True))


def bilinear(t: np.ndarray, y: np.ndarray, grid: np.ndarray, at_t: np.ndarray, at_y: np.ndarray, least: float = 1e-5) -> np.ndarray:
    """Volatility between the nodes of a grid (years by log-moneyness), held at its edges; missing nodes and results count as sqrt(least)."""
    spare = math.sqrt(least)
    nodes = np.where(np.isfinite(grid), grid, spare)

    def place(axis: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip(x, axis[0], axis[-1])
        i = np.clip(np.searchsorted(axis, x, "right") - 1, 0, len(axis) - 2)
        span = axis[i + 1] - axis[i]
        return i, np.where(span > 0, (x - axis[i]) / np.where(span > 0, span, 1), 0)

    (i, u), (j, v) = place(t, np.asarray(at_t, float)), place(y, np.asarray(at_y, float))
    out = (1 - u) * ((1 - v) * nodes[i, j] + v * nodes[i, j + 1]) + u * ((1 - v) * nodes[i + 1, j] + v * nodes[i + 1, j + 1])
    return np.where(np.isfinite(out) & (out > 0), out, spare)


def density(p: np.ndarray, spot: float, t: float, nodes: int = 401) -> dict:
    """Risk-neutral density from second differences of call prices; clipped and normalised; its mean and quantiles."""
    strikes = spot * np.exp(np.linspace(-0.6, 0.6, nodes))
    sigma = np.sqrt(np.maximum(svi(p, np.log(strikes / spot)), 1e-8) / t)
    c = black_scholes(spot, strikes, t, sigma)
    left, right = np.diff(c)[:-1] / np.diff(strikes)[:-1], np.diff(c)[1:] / np.diff(strikes)[1:]
    x = strikes[1:-1]
    f = np.maximum((right - left) / (0.5 * (strikes[2:] - strikes[:-2])), 0)
    area = np.concatenate([[0], np.cumsum(0.5 * (f[1:] + f[:-1]) * np.diff(x))])
    f, cdf = f / area[-1], area / area[-1]
    return {"mean": float(np.sum(0.5 * (f[1:] * x[1:] + f[:-1] * x[:-1]) * np.diff(x))), "q10": float(np.interp(0.1, cdf, x)), "q50": float(np.interp(0.5, cdf, x)), "q90": float(np.interp(0.9, cdf, x)), "raw_area": float(area[-1])}


def binomial(s, k, t: float, sigma, steps: int, call, american: bool, r: float = 0.045, q: float = 0.013) -> np.ndarray:
    """Cox-Ross-Rubinstein trees of many contracts with one maturity at once."""
    s, k, sigma, call = (np.atleast_1d(np.asarray(x, float))[:, None] for x in (s, k, sigma, call))
    dt, side = t / steps, 2 * call - 1
    up = np.exp(sigma * math.sqrt(dt))
    p, disc = (math.exp((r - q) * dt) - 1 / up) / (up - 1 / up), math.exp(-r * dt)
    v = np.maximum(side * (s * up ** np.arange(-steps, steps + 1, 2.0) - k), 0)
    for n in range(steps - 1, -1, -1):
        v = disc * (p * v[:, 1:] + (1 - p) * v[:, :-1])
        if american:
            v = np.maximum(v, side * (s * up ** np.arange(-n, n + 1, 2.0) - k))
    return v[:, 0]


def trinomial(s, k, t: float, sigma, steps: int, call, r: float = 0.045, q: float = 0.013, stretch: float = math.sqrt(3)) -> np.ndarray:
    """European values on three-way trees with the stretch of their jumps, many contracts at once."""
    s, k, sigma, call = (np.atleast_1d(np.asarray(x, float))[:, None] for x in (s, k, sigma, call))
    dt = t / steps
    jump, drift = stretch * sigma * math.sqrt(dt), (r - q - sigma * sigma / 2) * dt
    a, b = sigma * sigma * dt / jump**2 + (drift / jump) ** 2, drift / jump
    pu, pd = 0.5 * (a + b), 0.5 * (a - b)
    v = np.maximum((2 * call - 1) * (s * np.exp(jump * np.arange(-steps, steps + 1)) - k), 0)
    for _ in range(steps):
        v = math.exp(-r * dt) * (pu * v[:, 2:] + (1 - pu - pd) * v[:, 1:-1] + pd * v[:, :-2])
    return v[:, 0]


def merton_cf(u, t, p):
    sigma, lam, mu, delta = p
    drift = -0.5 * sigma**2 - lam * (math.exp(mu + delta**2 / 2) - 1)
    return np.exp(t * (1j * u * drift - 0.5 * sigma**2 * u**2 + lam * (np.exp(1j * u * mu - 0.5 * delta**2 * u**2) - 1)))


def heston_cf(u, t, p):
    v0, kappa, theta, xi, rho = p
    d = np.sqrt((rho * xi * 1j * u - kappa) ** 2 + xi**2 * (1j * u + u**2))
    g = (kappa - rho * xi * 1j * u - d) / (kappa - rho * xi * 1j * u + d)
    e = np.exp(-d * t)
    c = kappa * theta / xi**2 * ((kappa - rho * xi * 1j * u - d) * t - 2 * np.log((1 - g * e) / (1 - g)))
    return np.exp(c + v0 * (kappa - rho * xi * 1j * u - d) / xi**2 * (1 - e) / (1 - g * e))


def bates_cf(u, t, p):
    return heston_cf(u, t, p[:5]) * merton_cf(u, t, (0.0, *p[5:]))


def kou_cf(u, t, p):
    sigma, lam, up, eta1, eta2 = p
    jump = lambda z: up * eta1 / (eta1 - z) + (1 - up) * eta2 / (eta2 + z) - 1
    drift = -0.5 * sigma**2 - lam * jump(1.0)
    return np.exp(t * (1j * u * drift - 0.5 * sigma**2 * u**2 + lam * jump(1j * u)))


def variance_gamma_cf(u, t, p):
    sigma, nu, theta = p
    inside = max(1e-9, 1 - theta * nu - sigma**2 * nu / 2)
    return np.exp(1j * u * t * math.log(inside) / nu) * (1 - 1j * theta * nu * u + 0.5 * sigma**2 * nu * u**2) ** (-t / nu)


#: name: (characteristic function, start, low, high)
FOURIER: dict[str, tuple[Callable, tuple, tuple, tuple]] = {
    "merton": (merton_cf, (0.15, 0.5, -0.1, 0.15), (0.01, 0.0, -0.5, 0.01), (1.0, 5.0, 0.3, 0.6)),
    "heston": (heston_cf, (0.04, 2.0, 0.05, 0.5, -0.5), (1e-3, 0.05, 1e-3, 0.05, -0.99), (1.0, 15.0, 1.0, 3.0, 0.5)),
    "bates": (bates_cf, (0.03, 2.0, 0.04, 0.4, -0.5, 0.3, -0.1, 0.12), (1e-3, 0.05, 1e-3, 0.05, -0.99, 0.0, -0.5, 0.01), (1.0, 15.0, 1.0, 3.0, 0.5, 4.0, 0.3, 0.6)),
    "kou": (kou_cf, (0.15, 1.0, 0.4, 12.0, 8.0), (0.01, 0.0, 0.01, 1.5, 0.5), (1.0, 10.0, 0.99, 60.0, 60.0)),
    "variance_gamma": (variance_gamma_cf, (0.2, 0.2, -0.1), (0.01, 0.01, -0.8), (1.0, 2.0, 0.5)),
}


def fourier_calls(cf: Callable, p, s: float, k: np.ndarray, t: float, r: float = 0.045, q: float = 0.013, nodes: int = 601) -> np.ndarray:
    """Calls by the single-integral formula on the line Im u = -1/2, with nodes on a tangent-mapped grid."""
    return fourier_pricer(s, k, t, r, q, nodes)(cf, p)


def fourier_pricer(s: float, k: np.ndarray, t: float, r: float = 0.045, q: float = 0.013, nodes: int = 601) -> Callable:
    """(characteristic function, parameters) -> calls; what doesn't depend on these is computed once."""
    angle = (np.arange(nodes) + 0.5) / nodes * (math.pi / 2)
    u, weight = np.tan(angle) * 4, 4 / np.cos(angle) ** 2 * (math.pi / 2 / nodes)
    forward = s * math.exp((r - q) * t)
    phase, weight = np.outer(np.log(forward / k), u), weight / (u * u + 0.25)
    even, odd = np.cos(phase), np.sin(phase)

    def calls(cf: Callable, p) -> np.ndarray:
        phi = cf(u - 0.5j, t, p) * weight
        return math.exp(-r * t) * (forward - np.sqrt(forward * k) / math.pi * (even @ phi.real - odd @ phi.imag))

    return calls


def fit_fourier(name: str, s: float, k: np.ndarray, t: float, vol: np.ndarray, most: int = 4000) -> dict:
    """Parameters and volatility error of a model fitted to a slice by the simplex, and whether it settled."""
    cf, start, low, high = FOURIER[name]
    target, calls = black_scholes(s, k, t, vol, 0.045, 0.013), fourier_pricer(s, k, t)

    def cost(z: np.ndarray) -> float:
        p = np.clip(z, low, high)
        with np.errstate(all="ignore"):
            c = calls(cf, tuple(p))
        v = float(np.mean(((c - target) / s) ** 2))
        return (v if math.isfinite(v) else 1.0) + float(np.abs(z - p).sum())

    z, _, settled = settled_simplex(cost, np.array(start), step=0.25, most=most, tol=1e-14)
    p = np.clip(z, low, high)
    fitted = implied_volatility(calls(cf, tuple(p)), s, k, t, 0.045, 0.013)
    ok = np.isfinite(fitted)
    return {"model": name, "params": [float(x) for x in p], "rmse_vol": float(np.sqrt(np.mean((fitted[ok] - vol[ok]) ** 2))) if ok.any() else float("nan"), "priced": int(ok.sum()), "converged": settled}


def vanna_volga(s: float, t: float, k: np.ndarray, pivots: tuple[float, float, float], vols: tuple[float, float, float]) -> np.ndarray:
    """Volatilities at strikes from three quotes: the cost of matching vega, vanna and volga."""
    k1, k2, k3 = pivots
    flat = vols[1]
    vega = lambda x: s * np.sqrt(t) * np.exp(-0.5 * ((np.log(s / x) + flat**2 * t / 2) / (flat * np.sqrt(t))) ** 2) / math.sqrt(2 * math.pi)
    call = lambda x, v: black_scholes(s, np.atleast_1d(np.asarray(x, float)), t, np.atleast_1d(np.asarray(v, float)))
    ratio = lambda a, b, c: np.log(b / k) * np.log(c / k) / (np.log(b / a) * np.log(c / a))
    x1, x2, x3 = vega(k) / vega(k1) * ratio(k1, k2, k3), vega(k) / vega(k2) * ratio(k2, k1, k3), vega(k) / vega(k3) * ratio(k3, k1, k2)
    price = call(k, np.full(len(k), flat))
    for x, kk, v in ((x1, k1, vols[0]), (x2, k2, flat), (x3, k3, vols[2])):
        price = price + x * (call(kk, v) - call(kk, flat))
    return implied_volatility(price, s, k, t)
