"""Jump prices, rebuilt smiles and their wings against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vegaflow.models import surface
from vegaflow.models.optimise import black_scholes
from vegaflow.plans import smiles
from vegaflow.plans.risk import Q, R


def test_jump_prices_are_means_of_closed_forms(spark):
    rows = [(100.0, k, t, v) for k in (60.0, 95.0, 100.0, 150.0) for t in (1 / 365, 0.5, 2.0) for v in (0.1, 0.4)]
    df = spark.createDataFrame(rows, "s double, k double, t double, v double")
    got = df.select("s", "k", "t", "v", smiles.merton(*(F.col(c) for c in "sktv")).alias("m")).collect()
    for r in got:
        price = 0.0
        for n in range(60):  # weights of the real jumps; each term grows at its own rate and is discounted at the market's
            weight = math.exp(-smiles.JUMPS * r["t"]) * (smiles.JUMPS * r["t"]) ** n / math.factorial(n)
            rate = R - smiles.JUMPS * (math.exp(smiles.FACTOR) - 1) + n * smiles.FACTOR / r["t"]
            price += weight * math.exp((rate - R) * r["t"]) * black_scholes(r["s"], np.array([r["k"]]), r["t"], np.array([math.sqrt(r["v"] ** 2 + n * smiles.JUMP_DEV**2 / r["t"])]), rate, Q)[0]
        assert r["m"]["price"] == pytest.approx(price, abs=1e-5)
        assert -1e-6 <= r["m"]["delta"] <= 1 + 1e-6 and r["m"]["gamma"] >= 0


def test_rebuilt_prices_meet_the_three_quotes_and_match_the_solved_shares(spark):
    pivots, vols, s, t = (90.0, 101.0, 112.0), (0.26, 0.2, 0.19), 100.0, 0.4
    strikes = [80.0, 90.0, 97.0, 101.0, 105.5, 112.0, 120.0]
    df = spark.createDataFrame([(k,) for k in strikes], "k double")
    lits = lambda xs: [F.lit(x) for x in xs]
    got = [r[0] for r in df.select(smiles.vanna_volga_price(F.lit(s), F.col("k"), F.lit(t), lits(pivots), lits(vols))).collect()]

    def terms(k):
        root = vols[1] * math.sqrt(t)
        d = (math.log(s / k) + (R - Q) * t) / root + root / 2
        vega = s * math.exp(-Q * t) * math.exp(-d * d / 2) / math.sqrt(2 * math.pi) * math.sqrt(t)
        return vega, -vega * (d - root) / (s * root), vega * d * (d - root) / vols[1]

    call = lambda k, v: black_scholes(s, np.array([k]), t, np.array([v]), R, Q)[0]
    for k, price in zip(strikes, got, strict=True):
        shares = np.linalg.solve(np.array([terms(x) for x in pivots]).T, np.array(terms(k)))
        want = call(k, vols[1]) + sum(w * (call(x, v) - call(x, vols[1])) for w, x, v in zip(shares, pivots, vols, strict=True))
        assert price == pytest.approx(want, abs=1e-5)
    for x, v in zip(pivots, vols, strict=True):
        assert got[strikes.index(x)] == pytest.approx(call(x, v), abs=1e-5)


def test_wings_are_the_grid_points_nearest_to_the_delta(spark):
    rng = np.random.default_rng(3)
    rows = [(1, dte, 100.0, float(k), 0.2 + 0.1 * rng.random(), dte / 365) for dte in (7, 90) for k in (80, 83, 91, 99, 104, 118, 125)] + [(1, 400, 100.0, 100.0, 0.2, 400 / 365)]
    q = spark.createDataFrame(rows, "run_id int, dte int, spot double, strike double, iv double, t double")
    got = {r["dte"]: r for r in smiles.wings(q).collect()}
    assert set(got) == {7, 90}  # one quote has no grid
    for dte in (7, 90):
        own = sorted((r[3], r[4]) for r in rows if r[1] == dte)
        k, v = np.array(own).T
        x = k[0] + np.arange(201) / 200 * (k[-1] - k[0])
        vol, t = np.interp(np.log(x), np.log(k), v), dte / 365
        d = (np.log(100 / x) + (R - Q) * t) / (vol * np.sqrt(t)) + vol * np.sqrt(t) / 2
        n = np.array([0.5 * math.erfc(-y / math.sqrt(2)) for y in d])
        forward, carry = 100 * math.exp((R - Q) * t), math.exp(-Q * t)
        put = min((abs(carry * (m - 1) + 0.25), y) for y, m in zip(x, n, strict=True) if y <= forward)
        call = min((abs(carry * m - 0.25), y) for y, m in zip(x, n, strict=True) if y >= forward)
        assert got[dte]["p1"]["strike"] == pytest.approx(put[1]) and got[dte]["p3"]["strike"] == pytest.approx(call[1])
        assert got[dte]["p1"]["iv"] == pytest.approx(np.interp(np.log(put[1]), np.log(k), v))


def test_empty_slices_give_no_row(spark):
    q = spark.createDataFrame([], "run_id int, dte int, spot double, strike double, iv double, t double")
    assert smiles.wings(q).count() == 0
    assert surface.vanna_volga(100.0, 0.25, np.array([100.0]), (90.0, 100.0, 110.0), (0.2, 0.2, 0.2))[0] == pytest.approx(0.2, abs=1e-6)
