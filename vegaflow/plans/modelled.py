"""Model queries: one grouped function per key, or plain columns where a model has a closed form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.numeric import js_round
from vegaflow.models import garch, regimes, surface
from vegaflow.operators.clusters import window_clusters
from vegaflow.plans.registry import query
from vegaflow.sources.fixtures import BARS_SQL, CONTRACTS_SQL, contracts, daily_bars, sql_round, vol_indices


def own_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to many tasks for heavy work on small groups.

    Adaptive execution goes by bytes and would merge all such groups into one
    task; it leaves a stated number of partitions alone. There are many, so that
    few groups share one.
    """
    return df.repartition(min(4096, 32 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-the-money quotes within 25 % of spot: run_id, dte, spot, strike, iv; a slice is a listing, and so bounded."""
    c = contracts(spark, sf_dir)
    otm = F.when(F.col("strike") >= F.col("spot"), F.col("is_call")).otherwise(~F.col("is_call"))
    return c.where(otm & (F.abs(F.log(F.col("strike") / F.col("spot"))) <= 0.25)).select("run_id", "dte", "spot", "strike", "iv")


@query(f"""WITH {CONTRACTS_SQL} SELECT run_id, dte, count(*) AS n, min(strike) AS low, max(strike) AS high, {sql_round("sum(iv)", 6)} AS sum_iv FROM contracts
WHERE (strike >= spot) = is_call AND abs(ln(strike / spot)) <= 0.25e0 GROUP BY 1, 2""")
def otm_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The out-of-the-money slices that the models are fitted to."""
    return slices(spark, sf_dir).groupBy("run_id", "dte").agg(F.count("*").alias("n"), F.min("strike").alias("low"), F.max("strike").alias("high"), js_round(F.sum("iv"), 6).alias("sum_iv"))


#: The smiles of ``quoted_smiles``: skew, curvature and its decay, and how far a quote may lie off.
RHO, ETA, DECAY, OFF = -0.6, 1.1, 0.45, 0.001


def quoted_smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices whose quotes lie near a smile: the run's level, a curvature that decays with maturity as a power, and a small part of each quote's own deviation."""
    x = slices(spark, sf_dir)
    level = x.groupBy("run_id").agg(F.avg("iv").alias("level"))
    t, k = F.col("dte") / F.lit(365.0), F.log(F.col("strike") / F.col("spot"))
    theta = F.col("level") * F.col("level") * t
    bend = F.lit(ETA) * F.pow(theta, F.lit(-DECAY)) * F.pow(1 + theta, F.lit(DECAY - 1)) * k
    w = theta / 2 * (1 + RHO * bend + F.sqrt((bend + RHO) * (bend + RHO) + (1 - RHO * RHO)))
    return x.join(level, "run_id").select("run_id", "dte", "spot", "strike", (F.sqrt(w / t) + OFF * (F.col("iv") - F.col("level"))).alias("iv"))


SVI_SCHEMA = "run_id int, dte int, spot double, n int, a double, b double, rho double, m double, sigma double, rmse double, butterfly_ok boolean, floor_ok boolean, rmse_iv double"


def svi_parameters(q: DataFrame) -> DataFrame:
    """Raw smile parameters of each slice with vega weights."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t = key[1] / 365
        k, iv = np.log(g["strike"].to_numpy() / g["spot"].to_numpy()), g["iv"].to_numpy()
        d1 = -k / (iv * np.sqrt(t)) + iv * np.sqrt(t) / 2
        fitted = surface.fit_svi(k, iv * iv * t, np.exp(-0.5 * d1 * d1) + 1e-3)
        if fitted:
            w = surface.svi([fitted[x] for x in ("a", "b", "rho", "m", "sigma")], k)
            fitted["rmse_iv"] = float(np.sqrt(np.mean((np.sqrt(np.maximum(w, 0) / t) - iv) ** 2)))
        return pd.DataFrame([{"run_id": key[0], "dte": key[1], "spot": float(g["spot"].iloc[0]), "n": len(g), **fitted}] if fitted else [], columns=["run_id", "dte", "spot", "n", "a", "b", "rho", "m", "sigma", "rmse", "butterfly_ok", "floor_ok", "rmse_iv"])

    return own_tasks(q, "run_id", "dte").groupBy("run_id", "dte").applyInPandas(run, SVI_SCHEMA)


@query()
def svi_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smile parameters of every expiration, their error and arbitrage flags."""
    return svi_parameters(slices(spark, sf_dir)).drop("rmse_iv", "spot")


@query()
def risk_neutral_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and quantiles of the risk-neutral density of every expiration."""

    def run(frames):
        for f in frames:
            rows = [{"run_id": r.run_id, "dte": r.dte, **surface.density(np.array([r.a, r.b, r.rho, r.m, r.sigma]), r.spot, r.dte / 365)} for r in f.itertuples()]
            yield pd.DataFrame(rows, columns=["run_id", "dte", "mean", "q10", "q50", "q90", "raw_area"])

    return svi_parameters(slices(spark, sf_dir)).mapInPandas(run, "run_id int, dte int, mean double, q10 double, q50 double, q90 double, raw_area double")


#: The closed-form surface of a slice: its mean volatility v and years t give a = A v^2 t, b = B v sqrt(t), s = S + T sqrt(t).
SHAPE = {"A": 0.4, "B": 0.3, "rho": -0.4, "m": 0.01, "S": 0.15, "T": 0.05}
SURFACE_SQL = f"""{CONTRACTS_SQL}, level AS (SELECT run_id, dte, dte / 365e0 AS t, avg(iv) AS v FROM contracts GROUP BY 1, 2),
surface AS (SELECT run_id, dte, {SHAPE['A']!r}::DOUBLE * v * v * t AS a, {SHAPE['B']!r}::DOUBLE * v * sqrt(t) AS b, {SHAPE['rho']!r}::DOUBLE AS rho, {SHAPE['m']!r}::DOUBLE AS m, {SHAPE['S']!r}::DOUBLE + {SHAPE['T']!r}::DOUBLE * sqrt(t) AS s FROM level)"""


def surface_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, dte, a, b, rho, m, s of every slice, from its mean volatility."""
    t, v = F.col("dte") / F.lit(365.0), F.col("v")
    level = contracts(spark, sf_dir).groupBy("run_id", "dte").agg(F.avg("iv").alias("v"))
    return level.select("run_id", "dte", (SHAPE["A"] * v * v * t).alias("a"), (SHAPE["B"] * v * F.sqrt(t)).alias("b"), F.lit(SHAPE["rho"]).alias("rho"), F.lit(SHAPE["m"]).alias("m"), (F.lit(SHAPE["S"]) + SHAPE["T"] * F.sqrt(t)).alias("s"))


@query(f"""WITH {SURFACE_SQL}, x AS (SELECT *, dte / 365e0 AS t, a + b * (-rho * m + sqrt(m * m + s * s)) AS w0 FROM surface)
SELECT run_id, dte, {sql_round('w0 / t', 8)} AS v, {sql_round('b / sqrt(w0) / 2 * (-m / sqrt(m * m + s * s) + rho)', 8)} AS psi, {sql_round('b * (1 - rho) / sqrt(w0)', 8)} AS p, {sql_round('b * (1 + rho) / sqrt(w0)', 8)} AS c,
  {sql_round('(a + b * s * sqrt(1 - rho * rho)) / t', 8)} AS v_min, {sql_round('a - 0 + b * s * sqrt(1 - rho * rho) - w0', 8)} AS below FROM x""")
def svi_jump_wings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jump-wing form of the closed-form surface of every slice; ``fitted_jump_wings`` has that of the fits."""
    return jump_wings(surface_df(spark, sf_dir), "run_id")


def jump_wings(x: DataFrame, *keys: str) -> DataFrame:
    """Smile parameters (dte, a, b, rho, m, s) in the jump-wing form."""
    w0 = F.col("a") + F.col("b") * (-F.col("rho") * F.col("m") + F.sqrt(F.col("m") * F.col("m") + F.col("s") * F.col("s")))
    x = x.withColumns({"t": F.col("dte") / F.lit(365.0), "w0": w0})
    low = F.col("a") + F.col("b") * F.col("s") * F.sqrt(1 - F.col("rho") * F.col("rho"))
    wing = lambda sign: F.col("b") * (1 + sign * F.col("rho")) / F.sqrt("w0")
    psi = F.col("b") / F.sqrt("w0") / 2 * (-F.col("m") / F.sqrt(F.col("m") * F.col("m") + F.col("s") * F.col("s")) + F.col("rho"))
    return x.select(*keys, "dte", js_round(F.col("w0") / F.col("t"), 8).alias("v"), js_round(psi, 8).alias("psi"), js_round(wing(-1), 8).alias("p"), js_round(wing(1), 8).alias("c"), js_round(low / F.col("t"), 8).alias("v_min"), js_round(low - F.col("w0"), 8).alias("below"))


@query()
def fitted_jump_wings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jump-wing form of every fitted expiration; null where the variance at the money is not positive."""
    x = jump_wings(svi_parameters(slices(spark, sf_dir)).withColumnRenamed("sigma", "s"), "run_id")
    return x.select("run_id", "dte", *(F.when(F.col("v") > 0, F.col(c)).alias(c) for c in ("v", "psi", "p", "c", "v_min", "below")))


#: Slices with a larger error of volatility, and runs with fewer slices, have no local-volatility surface.
MOST_RMSE_IV, LEAST_SLICES = 0.012, 3


@query()
def fitted_local_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local volatility of the fitted surface of every run, on 32 x 64 cells with flags; a run without a surface has one row that says so."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g[g["rmse_iv"] <= MOST_RMSE_IV]
        if len(g) < LEAST_SLICES:
            return pd.DataFrame([{"run_id": key[0], "t": np.nan, "y": np.nan, "local_vol": np.nan, "flag": "no-surface"}])
        return pd.DataFrame({"run_id": key[0], **surface.local_volatility_grid(g["dte"].to_numpy() / 365, g[["a", "b", "rho", "m", "sigma"]].to_numpy())})

    return own_tasks(svi_parameters(quoted_smiles(spark, sf_dir)), "run_id").groupBy("run_id").applyInPandas(run, "run_id int, t double, y double, local_vol double, flag string")


@query(f"""WITH {SURFACE_SQL}, g AS (SELECT *, k / 4e1 AS k FROM surface, (SELECT unnest(generate_series(-16, 16)) AS k)), y AS (SELECT run_id, dte, k_1 AS k, a, b, rho, m, s FROM (SELECT run_id, dte, a, b, rho, m, s, g.k_1 FROM (SELECT run_id, dte, a, b, rho, m, s, i / 4e1 AS k_1 FROM surface, (SELECT unnest(generate_series(-16, 16)) AS i)) g)),
w AS (SELECT *, a + b * (rho * (k - m) + sqrt((k - m) * (k - m) + s * s)) AS w, b * (rho + (k - m) / sqrt((k - m) * (k - m) + s * s)) AS d1, b * s * s / pow((k - m) * (k - m) + s * s, 1.5e0) AS d2 FROM y),
q AS (SELECT *, (1 - k * d1 / (2 * w)) * (1 - k * d1 / (2 * w)) - d1 * d1 / 4 * (1 / w + 0.25e0) + d2 / 2 AS g, lead(w) OVER (PARTITION BY run_id, k ORDER BY dte) AS w2, lead(dte) OVER (PARTITION BY run_id, k ORDER BY dte) AS dte2 FROM w)
SELECT run_id, dte, {sql_round('k', 6)} AS k, {sql_round('sqrt(w / (dte / 365e0))', 8)} AS iv, {sql_round('g', 8)} AS durrleman, g >= 0 AS butterfly_ok, coalesce(w2 >= w, true) AS calendar_ok,
  {sql_round('CASE WHEN g > 0 AND w2 > w THEN sqrt((w2 - w) / ((dte2 - dte) / 365e0) / g) END', 8)} AS local_vol FROM q""".replace("g AS (SELECT *, k / 4e1 AS k FROM surface, (SELECT unnest(generate_series(-16, 16)) AS k)), ", ""))
def local_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implied and local volatility on a grid of every run's closed-form surface with butterfly and calendar checks (columns only)."""
    k, m, s = F.col("k"), F.col("m"), F.col("s")
    root = F.sqrt((k - m) * (k - m) + s * s)
    x = surface_df(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(-16), F.lit(16)))).withColumn("k", F.col("i") / F.lit(40.0))
    x = x.withColumns({"w": F.col("a") + F.col("b") * (F.col("rho") * (k - m) + root), "d1": F.col("b") * (F.col("rho") + (k - m) / root), "d2": F.col("b") * s * s / F.pow((k - m) * (k - m) + s * s, F.lit(1.5))})
    w, d1 = F.col("w"), F.col("d1")
    inner = 1 - k * d1 / (2 * w)
    later = Window.partitionBy("run_id", "i").orderBy("dte")
    x = x.withColumns({"g": inner * inner - d1 * d1 / 4 * (1 / w + 0.25) + F.col("d2") / 2, "w2": F.lead("w").over(later), "dte2": F.lead("dte").over(later)})
    local = F.when((F.col("g") > 0) & (F.col("w2") > w), F.sqrt((F.col("w2") - w) / ((F.col("dte2") - F.col("dte")) / F.lit(365.0)) / F.col("g")))
    return x.select("run_id", "dte", js_round(k, 6).alias("k"), js_round(F.sqrt(w / (F.col("dte") / F.lit(365.0))), 8).alias("iv"), js_round(F.col("g"), 8).alias("durrleman"), (F.col("g") >= 0).alias("butterfly_ok"), F.coalesce(F.col("w2") >= w, F.lit(True)).alias("calendar_ok"), js_round(local, 8).alias("local_vol"))


@query()
def lattice_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomial and trinomial values against the closed form, European and American, as steps grow."""
    grid = contracts(spark, sf_dir).select("run_id", "dte", "spot", "strike", "iv", "tau", "is_call").withColumn("steps", F.explode(F.array(*map(F.lit, (5, 25, 50, 100, 200, 400)))))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t, steps = float(g["tau"].iloc[0]), int(key[2])
        args = (g["spot"].to_numpy(), g["strike"].to_numpy(), t, g["iv"].to_numpy(), steps, g["is_call"].to_numpy())
        out = g[["run_id", "dte", "strike", "is_call", "steps"]].copy()
        out["european"], out["american"], out["trinomial"] = surface.binomial(*args, False), surface.binomial(*args, True), surface.trinomial(*args)
        return out

    return own_tasks(grid, "run_id", "dte", "steps").groupBy("run_id", "dte", "steps").applyInPandas(run, "run_id int, dte int, strike double, is_call boolean, steps int, european double, american double, trinomial double")


def fitted_models(q: DataFrame, models: Sequence[str]) -> DataFrame:
    """The named models fitted to every slice; a group per (run, expiration, model)."""
    jobs = q.withColumn("model", F.explode(F.array(*map(F.lit, models))))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("strike")
        f = surface.fit_fourier(key[2], float(g["spot"].iloc[0]), g["strike"].to_numpy(), key[1] / 365, g["iv"].to_numpy())
        return pd.DataFrame([{"run_id": key[0], "dte": key[1], **f}])

    return own_tasks(jobs, "run_id", "dte", "model").groupBy("run_id", "dte", "model").applyInPandas(run, "run_id int, dte int, model string, params array<double>, rmse_vol double, priced int, converged boolean")


@query()
def fourier_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump, stochastic-volatility and pure-jump models fitted to every slice."""
    return fitted_models(slices(spark, sf_dir), list(surface.FOURIER))


DELTA_SQL = "(0.02e0 - 0.03e0 * delta + 0.01e0 * delta * delta)"


@query(f"""WITH {CONTRACTS_SQL}, v AS (SELECT *, spot * 0.3989422804014327e0 * exp(-0.5e0 * d1 * d1) * sqrt(tau) AS vega, (lead(iv) OVER w - lag(iv) OVER w) / (lead(strike) OVER w - lag(strike) OVER w) AS slope FROM contracts WHERE is_call WINDOW w AS (PARTITION BY run_id, dte ORDER BY strike))
SELECT run_id, dte, strike, {sql_round('delta', 6)} AS sticky_strike, {sql_round('delta - vega * slope', 6)} AS sticky_delta, {sql_round(f'delta + vega / (spot * sqrt(tau)) * {DELTA_SQL}', 6)} AS minimum_variance FROM v WHERE slope IS NOT NULL""")
def delta_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas under sticky strike, sticky delta and the quadratic minimum-variance rule."""
    from vegaflow.functions.numeric import bs_vega

    w = Window.partitionBy("run_id", "dte").orderBy("strike")
    slope = (F.lead("iv").over(w) - F.lag("iv").over(w)) / (F.lead("strike").over(w) - F.lag("strike").over(w))
    v = contracts(spark, sf_dir).where("is_call").withColumns({"vega": bs_vega(F.col("spot"), F.col("strike"), F.col("tau"), F.col("iv")), "slope": slope}).where("slope is not null")
    d = F.col("delta")
    rule = F.lit(0.02) - F.lit(0.03) * d + F.lit(0.01) * d * d
    return v.select("run_id", "dte", "strike", js_round(d, 6).alias("sticky_strike"), js_round(d - F.col("vega") * F.col("slope"), 6).alias("sticky_delta"), js_round(d + F.col("vega") / (F.col("spot") * F.sqrt("tau")) * rule, 6).alias("minimum_variance"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trading_date, x: percent log returns of the index levels."""
    w = Window.partitionBy("symbol").orderBy("trading_date")
    return vol_indices(spark, sf_dir).select("symbol", "trading_date", (F.log(F.col("close") / F.lag("close").over(w)) * 100).alias("x")).where("x is not null")


def fitted_variances(r: DataFrame, models: Sequence[str]) -> DataFrame:
    """The named variance models fitted to each symbol's returns, a group per (symbol, model)."""
    jobs = r.withColumn("model", F.explode(F.array(*map(F.lit, models))))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"symbol": key[0], **garch.fit(key[1], g.sort_values("trading_date")["x"].to_numpy())}])

    return own_tasks(jobs, "symbol", "model").groupBy("symbol", "model").applyInPandas(run, "symbol string, model string, k int, n int, nll double, aic double, bic double, persistence double, sigma_1d double, sigma_20d double, converged boolean")


@query()
def garch_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The univariate variance models fitted to each index, with criteria and forecasts."""
    return fitted_variances(returns(spark, sf_dir), list(garch.MODELS))


@query()
def garch_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts weighted by criterion over three models, and evenly."""
    m = fitted_variances(returns(spark, sf_dir), ("GARCH", "GJR", "EGARCH"))
    w = F.exp(F.lit(-0.5) * (F.col("bic") - F.min("bic").over(Window.partitionBy("symbol"))))
    m = m.withColumn("w", w)
    return m.groupBy("symbol").agg((F.sum(F.col("w") * F.col("sigma_20d")) / F.sum("w")).alias("weighted_sigma"), F.avg("sigma_20d").alias("even_sigma"), F.min_by("model", "bic").alias("best"), F.bool_and("converged").alias("converged"))


@query()
def correlation_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each index with the first by four two-series models: constant, dynamic, diagonal BEKK, orthogonal factors."""
    r = returns(spark, sf_dir)
    base = r.where("symbol = 'VIX'").select("trading_date", F.col("x").alias("x"))
    j = r.where("symbol <> 'VIX'").select("symbol", "trading_date", F.col("x").alias("y")).join(base, "trading_date").withColumn("kind", F.explode(F.array(*map(F.lit, garch.PAIRS))))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"symbol": key[0], **garch.correlations(g.sort_values("trading_date"), key[1])}])

    return own_tasks(j, "symbol", "kind").groupBy("symbol", "kind").applyInPandas(run, "symbol string, model string, k int, nll double, correlation double, converged boolean")


@query()
def regime_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-component mixture, two-state switching and clusters of 20-day distributions, per index."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("trading_date")["x"].to_numpy()
        mix, hmm, cl = regimes.gaussian_mixture(x), regimes.markov_switching(x), regimes.wasserstein_clusters(x)
        return pd.DataFrame([{"symbol": key[0], "calm_weight": mix["weight"][0], "calm_sd": mix["sd"][0], "wild_sd": mix["sd"][1], "two_regimes": mix["bic_two"] < mix["bic_one"], "stay_calm": hmm["stay"][0], "stay_wild": hmm["stay"][1], "calm_now": hmm["calm_now"], "cluster_sd": list(map(float, cl["sd"])), "cluster_now": cl["now"]}])

    return own_tasks(returns(spark, sf_dir), "symbol").groupBy("symbol").applyInPandas(run, "symbol string, calm_weight double, calm_sd double, wild_sd double, two_regimes boolean, stay_calm double, stay_wild double, calm_now double, cluster_sd array<double>, cluster_now int")


@query()
def regime_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the 20-day return distributions of each index, calm first, and the one it is in now; windows are rows, rounds are aggregations."""
    return window_clusters(spark, returns(spark, sf_dir), "symbol", "trading_date", "x", 20, regimes.DRAWS)


LAGS, MOMENTS = (1, 2, 3, 5, 8, 13, 21, 34, 55), (0.5, 1.0, 1.5, 2.0, 3.0)


@query(f"""WITH {BARS_SQL}, x AS (SELECT row_number() OVER (ORDER BY trading_date) AS i, ln(close) AS v FROM bars), d AS (SELECT lag_days, abs(b.v - a.v) AS d FROM x a, (SELECT unnest({list(LAGS)}) AS lag_days) l, x b WHERE b.i = a.i + lag_days),
m AS (SELECT q, lag_days, avg(pow(d, q)) AS m FROM d, (SELECT unnest([{', '.join(f'{q}e0' for q in MOMENTS)}]) AS q) GROUP BY ALL)
SELECT q, {sql_round('regr_slope(ln(m), ln(lag_days))', 6)} AS zeta, {sql_round('regr_slope(ln(m), ln(lag_days)) / q', 6)} AS hurst, {sql_round('regr_r2(ln(m), ln(lag_days))', 6)} AS r2 FROM m GROUP BY q""")
def structure_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling exponents of absolute moments over lags: window leads and two aggregations, no self-join."""
    w = Window.orderBy("trading_date")
    x = daily_bars(spark, sf_dir).select(F.log("close").alias("v"), *(F.abs(F.lead(F.log("close"), k).over(w) - F.log("close")).alias(f"d{k}") for k in LAGS))
    moments = x.agg(*(F.avg(F.pow(f"d{k}", F.lit(q))).alias(f"m{k}_{i}") for k in LAGS for i, q in enumerate(MOMENTS)))
    rows = F.array(*(F.struct(F.lit(q).alias("q"), F.log(F.lit(float(k))).alias("x"), F.log(F.col(f"m{k}_{i}")).alias("y")) for k in LAGS for i, q in enumerate(MOMENTS)))
    g = moments.select(F.inline(rows)).groupBy("q").agg(F.regr_slope("y", "x").alias("zeta"), F.regr_r2("y", "x").alias("r2"))
    return g.select("q", js_round(F.col("zeta"), 6).alias("zeta"), js_round(F.col("zeta") / F.col("q"), 6).alias("hurst"), js_round(F.col("r2"), 6).alias("r2"))


SIZES = (8, 12, 16, 24, 32, 48, 64, 96, 128)


@query(f"""WITH {BARS_SQL}, r AS (SELECT row_number() OVER (ORDER BY trading_date) - 2 AS i, ln(close) - lag(ln(close)) OVER (ORDER BY trading_date) AS x FROM bars), c AS (SELECT i, x - (SELECT avg(x) FROM r) AS x FROM r WHERE x IS NOT NULL),
p AS (SELECT i, sum(x) OVER (ORDER BY i) AS y FROM c), n AS (SELECT count(*) AS n FROM c), s AS (SELECT unnest({list(SIZES)}) AS size),
b AS (SELECT size, i // size AS box, regr_count(y, i) AS k, regr_syy(y, i) - regr_sxy(y, i) * regr_sxy(y, i) / regr_sxx(y, i) AS sse FROM p, s, n WHERE i < (n // size) * size GROUP BY ALL),
f AS (SELECT size, sqrt(sum(sse) / sum(k)) AS f, count(*) AS boxes FROM b GROUP BY 1)
SELECT {sql_round('regr_slope(ln(f), ln(size))', 6)} AS hurst, {sql_round('regr_r2(ln(f), ln(size))', 6)} AS r2, CAST(sum(boxes) AS BIGINT) AS boxes FROM f""")
def detrended_fluctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling of residuals around linear trends in boxes of growing size."""
    w = Window.orderBy("trading_date")
    r = daily_bars(spark, sf_dir).select((F.row_number().over(w) - 2).alias("i"), (F.log("close") - F.lag(F.log("close")).over(w)).alias("x")).where("x is not null")
    s = r.agg(F.avg("x").alias("mean"), F.count("*").alias("n")).first()
    p = r.select("i", F.sum(F.col("x") - F.lit(s["mean"] or 0.0)).over(Window.orderBy("i")).alias("y"))
    b = p.withColumn("size", F.explode(F.array(*map(F.lit, SIZES)))).where(F.col("i") < F.floor(F.lit(s["n"]) / F.col("size")) * F.col("size"))
    b = b.groupBy("size", F.floor(F.col("i") / F.col("size")).alias("box")).agg(F.count("*").alias("k"), (F.regr_syy("y", "i") - F.regr_sxy("y", "i") * F.regr_sxy("y", "i") / F.regr_sxx("y", "i")).alias("sse"))
    f = b.groupBy("size").agg(F.sqrt(F.sum("sse") / F.sum("k")).alias("f"), F.count("*").alias("boxes"))
    return f.agg(js_round(F.regr_slope(F.log("f"), F.log("size")), 6).alias("hurst"), js_round(F.regr_r2(F.log("f"), F.log("size")), 6).alias("r2"), F.sum("boxes").alias("boxes"))
