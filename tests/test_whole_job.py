"""Queries that have no SQL do their whole job: against plain Python on the smallest tables."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from vegaflow.models import garch, surface
from vegaflow.plans import daily, modelled, registered
from vegaflow.sources.fixtures import term_structure

QUERIES = registered().QUERIES


def test_bands_of_every_trading_day(spark, sf):
    t = term_structure(spark, sf).toPandas()
    day, dte, iv = np.array(t.trading_date, "datetime64[D]").astype(int), t.dte.to_numpy(), t.atm_iv.to_numpy()
    r = QUERIES["cloud_bands_history"](spark, sf).toPandas()
    assert len(r) == len(set(day)) * 281 == len(r[["trading_date", "dte"]].drop_duplicates())
    for x in r.sample(500, random_state=0).itertuples():
        at = np.datetime64(x.trading_date, "D").astype(int)
        v = iv[(np.abs(dte - x.dte) <= (1 if x.dte < 7 else 3)) & (day >= at - 365) & (day <= at - 1)]
        assert x.sample_count == len(v)
        got = [x.iv_p10, x.iv_p30, x.iv_p50, x.iv_p70, x.iv_p90]
        assert np.allclose(got, np.quantile(v, (0.1, 0.3, 0.5, 0.7, 0.9)), atol=2e-6) if len(v) else np.isnan(np.array(got, float)).all()
    last = r[r.trading_date >= sorted(set(r.trading_date))[-5]]
    five = QUERIES["cloud_bands"](spark, sf).toPandas()
    key = ["trading_date", "dte"]
    assert last.sort_values(key).reset_index(drop=True).equals(five.sort_values(key)[last.columns].reset_index(drop=True))
    report = {x["phase"]: x["n_rows"] for x in QUERIES["end_of_day"](spark, sf).collect()}
    assert report["cloud_bands"] == len(r)


def test_the_latest_premium_ranks_among_its_year_before_it_is_rounded(spark, monkeypatch):
    rows = [("2001-07-30", 0.26, 54.5), ("2001-07-31", 0.26, 54.16926979926346), ("2001-08-01", 0.26, 54.87404894965621)]
    stats = spark.createDataFrame(rows, "day string, iv double, hv double").selectExpr("to_date(day) as trading_date", "iv", "hv")
    monkeypatch.setattr(daily, "vol_stats_of", lambda *_: stats)
    r = QUERIES["vrp_summary"](spark, "").first()
    assert (r["vrp"], r["prev_vrp"], r["pct_rank_252d"]) == (-54.614049, -53.90927, 33.3)
    monkeypatch.setattr(daily, "vol_stats_of", lambda *_: stats.where("iv - hv < -54.5"))
    r = QUERIES["vrp_summary"](spark, "").first()
    assert (r["vrp"], r["prev_vrp"], r["pct_rank_252d"]) == (-54.614049, None, 100.0)


def test_a_smile_of_a_model_is_fitted_until_it_settles():
    p, k = (0.04, 2.0, 0.05, 0.5, -0.5), np.linspace(4000, 6000, 41)
    near = surface.fourier_calls(surface.heston_cf, p, 5000.0, k, 18 / 365)
    assert np.abs(near - surface.fourier_calls(surface.heston_cf, p, 5000.0, k, 18 / 365, nodes=4001)).max() < 0.05
    other = (0.06, 3.0, 0.04, 0.7, -0.6)
    for t in (0.255, 0.46):
        vol = surface.implied_volatility(surface.fourier_calls(surface.heston_cf, other, 5000.0, k, t), 5000.0, k, t, 0.045, 0.013)
        f = surface.fit_fourier("heston", 5000.0, k, t, vol)
        assert f["converged"] and f["rmse_vol"] < 1e-4
        assert not surface.fit_fourier("heston", 5000.0, k, t, vol, most=5)["converged"]


def test_variance_models_of_a_short_series_settle(spark, sf, monkeypatch):
    whole = modelled.returns
    monkeypatch.setattr(modelled, "returns", lambda s, d: whole(s, d).where("symbol in ('VIX', 'VVIX')").withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("trading_date"))).where("i <= 200"))
    models = QUERIES["garch_models"](spark, sf).toPandas()
    assert len(models) == 2 * len(garch.MODELS) and models.converged.mean() > 0.9 and (models.sigma_1d > 0).all()
    ensemble = QUERIES["garch_ensemble"](spark, sf).toPandas()
    three = models[models.model.isin(["GARCH", "GJR", "EGARCH"])]
    assert sorted(ensemble.symbol) == ["VIX", "VVIX"] and set(ensemble.best) <= {"GARCH", "GJR", "EGARCH"}
    assert dict(zip(ensemble.symbol, ensemble.converged)) == three.groupby("symbol").converged.all().to_dict()
    both = QUERIES["correlation_models"](spark, sf).toPandas()
    assert sorted(both.model) == sorted(garch.PAIRS) and both.converged.all()


def test_every_fitted_expiration_has_jump_wings_and_every_run_a_local_surface(spark, sf):
    fits = QUERIES["svi_surface"](spark, sf).toPandas()
    wings = QUERIES["fitted_jump_wings"](spark, sf).toPandas().set_index(["run_id", "dte"])
    assert len(wings) == len(fits) > 4 and wings.index.is_unique
    for f in fits.itertuples():
        root = np.hypot(f.m, f.sigma)
        w0 = f.a + f.b * (-f.rho * f.m + root)
        if w0 > 1e-6:
            x = wings.loc[(f.run_id, f.dte)]
            assert np.allclose([x.v, x.psi, x.p, x.c], [w0 / (f.dte / 365), f.b * (f.rho - f.m / root) / 2 / np.sqrt(w0), f.b * (1 - f.rho) / np.sqrt(w0), f.b * (1 + f.rho) / np.sqrt(w0)], atol=1e-7)
    local = QUERIES["fitted_local_volatility"](spark, sf).toPandas()
    assert set(local.run_id) == set(fits.run_id) and set(local.groupby("run_id").size()) == {32 * 64}
    assert (local.flag == "ok").mean() > 0.5 and local[local.flag == "ok"].local_vol.between(0.01, 3).all()


def test_the_skew_of_smiles_decays_as_they_were_made(spark, sf):
    law = QUERIES["skew_power_law"](spark, sf).toPandas()
    assert (law.slices >= 3).all() and (law.r2 > 0.9).all() and law.slope.between(-0.6, -0.2).all() and law.level.gt(0).all()


#: Parameters of a surface: (dte, a, b, rho, m, sigma).
SURFACE = [(30, 0.002, 0.04, -0.4, 0.01, 0.12), (60, 0.004, 0.05, -0.35, 0.01, 0.15), (120, 0.008, 0.06, -0.3, 0.02, 0.2), (240, 0.016, 0.07, -0.25, 0.02, 0.25)]


def test_local_volatility_by_cells():
    rows = np.array(SURFACE)
    t, p = rows[:, 0] / 365, rows[:, 1:]
    got = surface.local_volatility_grid(t[::-1], p[::-1])
    assert len(got["t"]) == 32 * 64 and (got["flag"] == "ok").any()
    for c in range(0, 2048, 41):
        x, y = got["t"][c], got["y"][c]
        i = max(j for j in range(3) if j == 0 or t[j] < x)
        w = lambda z, at: (1 - at) * surface.svi(p[i], z) + at * surface.svi(p[i + 1], z)
        at, h = min(1, max(0, (x - t[i]) / (t[i + 1] - t[i]))), 1e-4
        v, d1, d2 = w(y, at), (w(y + h, at) - w(y - h, at)) / (2 * h), (w(y + h, at) - 2 * w(y, at) + w(y - h, at)) / h**2
        n = 1 - y / v * d1 + 0.25 * (-0.25 - 1 / v + y * y / v**2) * d1**2 + d2 / 2
        want = (w(y, 1) - w(y, 0)) / (t[i + 1] - t[i]) / n
        assert got["flag"][c] == "ok" and abs(got["local_vol"][c] - np.sqrt(want)) < 1e-5
