"""Invariants of the models."""

import math

import numpy as np
import pandas as pd
import pytest

from vegaflow.models import garch, regimes, surface
from vegaflow.models.optimise import black_scholes, damped_least_squares, implied_volatility, norm_cdf, simplex


def test_minimisers():
    x, v = simplex(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + 1) ** 2, np.array([0.0, 0.0]), most=400)
    assert np.allclose(x, [3, -1], atol=1e-3)
    t = np.linspace(0, 4, 30)
    x, c = damped_least_squares(lambda p: p[0] * np.exp(-p[1] * t) - 2 * np.exp(-0.7 * t), np.array([1.0, 0.2]))
    assert np.allclose(x, [2, 0.7], atol=1e-6) and norm_cdf(np.array([0.0]))[0] == pytest.approx(0.5, abs=1e-7)


def test_implied_volatility_round_trip():
    k = np.array([80, 100, 125.0])
    assert np.allclose(implied_volatility(black_scholes(100, k, 0.5, np.array([0.3, 0.2, 0.25])), 100, k, 0.5), [0.3, 0.2, 0.25], atol=1e-6)


def test_svi_recovers_its_own_smile():
    p = np.array([0.01, 0.1, -0.4, 0.02, 0.15])
    k = np.linspace(-0.3, 0.3, 25)
    f = surface.fit_svi(k, surface.svi(p, k), np.ones(25))
    assert f["rmse"] < 1e-6 and f["butterfly_ok"] and surface.fit_svi(k[:5], k[:5] + 1, np.ones(5)) is None
    d = surface.density(p, 100.0, 0.5)
    assert d["raw_area"] == pytest.approx(1, abs=0.05) and d["q10"] < d["q50"] < d["q90"] and d["mean"] == pytest.approx(100, rel=0.02)


def test_trees_converge():
    exact = black_scholes(100, np.array([105.0]), 0.5, np.array([0.25]), 0.045, 0.013)[0]
    assert surface.binomial(100, 105, 0.5, 0.25, 400, True, False) == pytest.approx(exact, abs=0.02)
    assert surface.trinomial(100, 105, 0.5, 0.25, 300, True) == pytest.approx(exact, abs=0.02)
    assert surface.binomial(100, 105, 0.5, 0.25, 200, False, True) >= surface.binomial(100, 105, 0.5, 0.25, 200, False, False)


def test_fourier_models_without_their_extras_are_lognormal():
    k = np.array([85, 100, 115.0])
    want = black_scholes(100, k, 0.5, np.full(3, 0.2), 0.045, 0.013)
    for name, p in (("merton", (0.2, 0.0, 0.0, 0.1)), ("kou", (0.2, 0.0, 0.5, 10.0, 10.0)), ("heston", (0.04, 2.0, 0.04, 1e-3, 0.0))):
        assert np.allclose(surface.fourier_calls(surface.FOURIER[name][0], p, 100, k, 0.5), want, atol=0.02), name
    forward = surface.fourier_calls(surface.variance_gamma_cf, (0.2, 0.2, -0.1), 100, np.array([1e-3]), 0.5)[0]
    assert forward == pytest.approx(100 * math.exp(-0.013 * 0.5), rel=1e-2)


def test_fitted_models_are_close():
    k = np.linspace(85, 115, 13)
    vol = 0.2 + 0.1 * np.log(k / 100) ** 2 - 0.05 * np.log(k / 100)
    assert all(surface.fit_fourier(n, 100.0, k, 0.25, vol)["rmse_vol"] < 0.02 for n in surface.FOURIER)
    vv = surface.vanna_volga(100.0, 0.25, k, (90.0, 100.0, 110.0), tuple(np.interp([90, 100, 110], k, vol)))
    assert np.nanmax(np.abs(vv - vol)[4:9]) < 0.01


def test_every_variance_model_fits_and_is_positive():
    rng = np.random.default_rng(0)
    h, x = 1.0, []
    for _ in range(500):
        e = rng.normal() * math.sqrt(h)
        x.append(e)
        h = 0.05 + 0.1 * e * e + 0.85 * h
    x = np.array(x)
    plain = garch.likelihood(garch.MODELS["GARCH"], np.array([x.var() * 0.999, 0.0005, 0.0005]), x - x.mean(), x.var())
    for name in garch.MODELS:
        f = garch.fit(name, x, most=120)
        assert math.isfinite(f["nll"]) and f["sigma_1d"] > 0 and f["k"] == len(garch.MODELS[name].low), name
    assert garch.fit("GARCH", x)["nll"] < plain


def test_regimes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 400), rng.normal(0, 4, 200), rng.normal(0, 1, 300)])
    m = regimes.gaussian_mixture(x)
    assert m["sd"][0] < 1.6 < m["sd"][1] and m["bic_two"] < m["bic_one"] and all(b >= a - 1e-6 for a, b in zip(m["trace"], m["trace"][1:]))
    s = regimes.markov_switching(x)
    assert s["stay"].min() > 0.9 and s["calm_now"] > 0.9 and all(b >= a - 1e-6 for a, b in zip(s["trace"], s["trace"][1:]))
    c = regimes.wasserstein_clusters(x)
    assert c["sd"][0] < c["sd"][2] and c["share"].sum() == pytest.approx(1)


def test_forecasts_are_those_of_each_model():
    x = np.random.default_rng(5).normal(size=400)
    w, a, b = 0.05, 0.1, 0.85
    h = garch.ahead("GARCH", np.array([w, a, b]), x, 1.0)
    assert np.allclose(np.diff(h), [w + (a + b - 1) * v for v in h[:-1]])  # towards its own level, not the sample's
    h = garch.ahead("IGARCH", np.array([w, a]), x, 1.0)
    assert np.allclose(np.diff(h), w)  # never reverts
    h = garch.ahead("GJR", np.array([w, 0.05, 0.1, b]), x, 1.0)
    assert h[0] > 0 and np.allclose(np.diff(h), [w + (0.05 + 0.05 + b - 1) * v for v in h[:-1]])
    assert np.isfinite(garch.ahead("EGARCH", np.array([0.0, 0.1, -0.05, 0.95]), x, 1.0)).all()
    assert (garch.ahead("GAS", np.array([0.0, 0.05, 0.95]), x, 1.0) == garch.ahead("GAS", np.array([0.0, 0.05, 0.95]), x, 1.0)).all()


def test_pairs_find_the_correlation():
    rng = np.random.default_rng(6)
    z = rng.normal(size=(600, 2))
    f = pd.DataFrame({"x": z[:, 0], "y": 0.7 * z[:, 0] + np.sqrt(1 - 0.49) * z[:, 1]})
    assert all(abs(garch.correlations(f, kind)["correlation"] - 0.7) < 0.15 for kind in garch.PAIRS)


def test_bilinear_at_nodes_between_and_beyond():
    t, y = np.array([0.1, 1.0]), np.array([-0.2, 0.0, 0.2])
    g = np.array([[0.1, 0.2, np.nan], [0.3, 0.4, 0.5]])
    got = surface.bilinear(t, y, g, np.array([0.1, 0.55, 5.0, 0.1]), np.array([-0.2, -0.1, 1.0, 0.2]))
    assert np.allclose(got, [0.1, 0.25, 0.5, 1e-5**0.5])


def test_surface_fit_finds_its_parameters():
    t = np.repeat([0.1, 0.3, 1.0], 21)
    k = np.tile(np.linspace(-0.2, 0.2, 21), 3)
    iv = np.sqrt(surface.ssvi(0.04 * t, k, -0.6, 1.1, 0.45) / t)
    got = surface.fit_ssvi(t, k, iv)
    assert abs(got["rho"] + 0.6) < 0.03 and got["rmse_iv"] < 1e-3 and got["calendar_ok"] and got["butterfly_ok"]
    assert surface.fit_ssvi(t[:10], k[:10], iv[:10]) is None


def test_skew_law_finds_its_exponent(spark):
    from vegaflow.plans.risk import skew_law

    rows = []
    for dte in (10, 30, 60, 120, 240):  # skew = 0.5 t^-0.4 at w0 = 0.04 t with m = 0
        t = dte / 365
        skew, sigma, rho = 0.5 * t**-0.4, 0.1, -0.5
        b = skew * 2 * math.sqrt(t * 0.04 * t) / abs(rho)
        rows.append((1, dte, 0.04 * t - b * sigma, b, rho, 0.0, sigma, 0.001))
    rows += [(2, 30, 0.01, 0.1, -0.5, 0.0, 0.1, 0.5)]
    got = {r["run_id"]: r for r in skew_law(spark.createDataFrame(rows, "run_id int, dte int, a double, b double, rho double, m double, sigma double, rmse_iv double")).collect()}
    assert got[1]["slope"] == pytest.approx(-0.4) and got[1]["hurst"] == pytest.approx(0.1) and got[1]["level"] == pytest.approx(0.5) and got[2]["slope"] is None
