"""Greeks across models and over the surface, the surface fit of all expirations, and the law of the skew."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vegaflow.functions.numeric import bachelier_greeks, bs_charm, bs_delta, bs_gamma, bs_price, bs_vanna, bs_vega, bs_volga, implied_volatility, js_round, log_gamma
from vegaflow.models import surface
from vegaflow.operators.stochastic import BUMP, END_SPREADS, LEAST_END, NODES, heston_greeks
from vegaflow.plans.modelled import fitted_models, own_tasks, quoted_smiles, slices, svi_parameters
from vegaflow.plans.registry import query
from vegaflow.sources.fixtures import CONTRACTS_SQL, contracts, sql_cdf, sql_pdf, sql_round, table

#: Carry of the model pages.
R, Q = 0.045, 0.013

CARRY_SQL = f"""{CONTRACTS_SQL}, carried AS (SELECT run_id, dte, strike, is_call, spot, iv, tau, spot * exp({R - Q!r}::DOUBLE * tau) AS f, exp(-{Q!r}::DOUBLE * tau) AS dq, (ln(spot / strike) + ({R - Q!r}::DOUBLE + 0.5e0 * iv * iv) * tau) / (iv * sqrt(tau)) AS d, iv * spot * exp({R - Q!r}::DOUBLE * tau) * sqrt(tau) AS sn FROM contracts)"""
NORMAL_D = "((f - strike) / sn)"

#: Speed, volatility and correlation of the variance where nothing is fitted; level and mean are those at the money.
KAPPA, XI, RHO = 2.0, 0.4, -0.7


def money_slices(c: DataFrame) -> DataFrame:
    """run_id, dte, tau and the five parameters of each slice: variance and its mean from the quote nearest the spot."""
    near = F.min_by("iv", F.struct(F.abs(F.col("strike") - F.col("spot")), "strike", "is_call"))
    at = c.groupBy("run_id", "dte").agg(F.max("tau").alias("tau"), near.alias("v"))
    return at.select("run_id", "dte", "tau", (F.col("v") * F.col("v")).alias("v0"), F.lit(KAPPA).alias("kappa"), (F.col("v") * F.col("v")).alias("theta"), F.lit(XI).alias("xi"), F.lit(RHO).alias("rho"))


def under_heston(c: DataFrame, slices: DataFrame) -> DataFrame:
    """run_id, dte, strike, is_call, delta, gamma, vega of every contract."""
    g = heston_greeks(c, slices, ["run_id", "dte"], R, Q).drop("price")
    of = c.select("run_id", "dte", "strike", "is_call", "tau").join(g, ["run_id", "dte", "strike"])
    delta = F.when(F.col("is_call"), F.col("delta")).otherwise(F.col("delta") - F.exp(F.lit(-Q) * F.col("tau")))
    return of.select("run_id", "dte", "strike", "is_call", delta.alias("delta"), "gamma", "vega")


def heston_sql() -> str:
    """CTEs from ``carried`` to ``heston`` (delta, gamma and vega of calls by run, expiration and strike)."""
    ends = {"": "v0", "up_": f"pow(sqrt(v0) + {BUMP!r}::DOUBLE, 2)", "down_": f"greatest(pow(sqrt(v0) - {BUMP!r}::DOUBLE, 2), 1e-8)"}
    values = ", ".join(f"exp(a_re + b_re * {v}) * cos(a_im + b_im * {v}) AS {n}re, exp(a_re + b_re * {v}) * sin(a_im + b_im * {v}) AS {n}im" for n, v in ends.items())
    sums = ", ".join(f"sum(CASE WHEN j = {j} THEN (cos(u * x) * {n}im + sin(u * x) * {n}re) / u * gap / pi() END) AS {n}p{j}" for n in ends for j in (1, 2))
    price = lambda n: f"(spot * dq * (0.5e0 + {n}p1) - strike * exp(-{R!r}::DOUBLE * tau) * (0.5e0 + {n}p2))"
    return f"""
money AS (SELECT run_id, dte, max(tau) AS tau, arg_min(iv, {{'a': abs(strike - spot), 'b': strike, 'c': is_call}}) AS v FROM carried GROUP BY 1, 2),
node AS (SELECT run_id, dte, tau, v * v AS v0, v * v AS theta, ({LEAST_END!r}::DOUBLE + {END_SPREADS!r}::DOUBLE / sqrt(v * v * tau)) / {NODES} AS gap, i, j FROM money, (SELECT unnest(generate_series(0, {NODES - 1})) AS i), (SELECT unnest([1, 2]) AS j)),
n0 AS (SELECT *, (i + 0.5e0) * gap AS u, CASE WHEN j = 1 THEN {KAPPA - RHO * XI!r}::DOUBLE ELSE {KAPPA!r}::DOUBLE END AS be_re, {-RHO * XI!r}::DOUBLE * (i + 0.5e0) * gap AS be_im FROM node),
n1 AS (SELECT *, be_re * be_re - be_im * be_im + {XI * XI!r}::DOUBLE * u * u AS s_re, 2 * be_re * be_im + CASE WHEN j = 1 THEN -1 ELSE 1 END * {XI * XI!r}::DOUBLE * u AS s_im FROM n0),
n2 AS (SELECT *, sqrt((sqrt(s_re * s_re + s_im * s_im) + s_re) / 2) AS d_re, CASE WHEN s_im < 0 THEN -1 ELSE 1 END * sqrt(greatest(sqrt(s_re * s_re + s_im * s_im) - s_re, 0) / 2) AS d_im FROM n1),
n3 AS (SELECT *, be_re - d_re AS l_re, be_im - d_im AS l_im, ((be_re - d_re) * (be_re + d_re) + (be_im - d_im) * (be_im + d_im)) / (pow(be_re + d_re, 2) + pow(be_im + d_im, 2)) AS g_re, ((be_im - d_im) * (be_re + d_re) - (be_re - d_re) * (be_im + d_im)) / (pow(be_re + d_re, 2) + pow(be_im + d_im, 2)) AS g_im, exp(-d_re * tau) * cos(-d_im * tau) AS e_re, exp(-d_re * tau) * sin(-d_im * tau) AS e_im FROM n2),
n4 AS (SELECT *, 1 - (g_re * e_re - g_im * e_im) AS r_re, -(g_re * e_im + g_im * e_re) AS r_im FROM n3),
n5 AS (SELECT *, (r_re * (1 - g_re) - r_im * g_im) / (pow(1 - g_re, 2) + g_im * g_im) AS q_re, (r_im * (1 - g_re) + r_re * g_im) / (pow(1 - g_re, 2) + g_im * g_im) AS q_im, ((1 - e_re) * r_re - e_im * r_im) / (r_re * r_re + r_im * r_im) AS f_re, (-e_im * r_re - (1 - e_re) * r_im) / (r_re * r_re + r_im * r_im) AS f_im FROM n4),
n6 AS (SELECT *, {KAPPA / (XI * XI)!r}::DOUBLE * theta * (l_re * tau - ln(q_re * q_re + q_im * q_im)) AS a_re, {KAPPA / (XI * XI)!r}::DOUBLE * theta * (l_im * tau - 2 * atan2(q_im, q_re)) AS a_im, (l_re * f_re - l_im * f_im) / {XI * XI!r}::DOUBLE AS b_re, (l_re * f_im + l_im * f_re) / {XI * XI!r}::DOUBLE AS b_im FROM n5),
values_at AS (SELECT run_id, dte, j, u, gap, {values} FROM n6),
strikes AS (SELECT DISTINCT run_id, dte, strike, spot, tau, dq, ln(spot / strike) + {R - Q!r}::DOUBLE * tau AS x FROM carried),
summed_up AS (SELECT run_id, dte, strike, spot, tau, dq, {sums}, sum(CASE WHEN j = 1 THEN (cos(u * x) * re - sin(u * x) * im) * gap / pi() END) AS slope FROM strikes JOIN values_at USING (run_id, dte) GROUP BY ALL),
heston AS (SELECT run_id, dte, strike, dq * (0.5e0 + p1) AS delta, dq * slope / spot AS gamma, ({price('up_')} - {price('down_')}) / {2 * BUMP!r}::DOUBLE AS vega FROM summed_up)"""


@query(f"""WITH {CARRY_SQL}, {heston_sql()}, m AS (
  SELECT run_id, dte, strike, is_call, 'lognormal' AS model, dq * ({sql_cdf('d')} - CASE WHEN is_call THEN 0e0 ELSE 1e0 END) AS delta, dq * {sql_pdf('d')} / (spot * iv * sqrt(tau)) AS gamma, spot * dq * {sql_pdf('d')} * sqrt(tau) AS vega FROM carried
  UNION ALL SELECT run_id, dte, strike, is_call, 'normal', dq * ({sql_cdf(NORMAL_D)} - CASE WHEN is_call THEN 0e0 ELSE 1e0 END), dq * {sql_pdf(NORMAL_D)} / sn, f * exp(-{R!r}::DOUBLE * tau) * {sql_pdf(NORMAL_D)} * sqrt(tau) FROM carried
  UNION ALL SELECT run_id, dte, strike, is_call, 'heston', h.delta - CASE WHEN is_call THEN 0e0 ELSE dq END, h.gamma, h.vega FROM carried JOIN heston h USING (run_id, dte, strike))
SELECT run_id, dte, strike, is_call, model, {sql_round('delta', 6)} AS delta, {sql_round('gamma', 9)} AS gamma, {sql_round('vega', 4)} AS vega FROM m""")
def cross_model_greeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta, gamma and vega of every contract under a lognormal and a normal spot of equal volatility, and under stochastic volatility that is the slice's at the money."""
    c = contracts(spark, sf_dir)
    s, k, t, v, call = (F.col(x) for x in ("spot", "strike", "tau", "iv", "is_call"))
    lognormal = F.struct(F.lit("lognormal").alias("model"), bs_delta(s, k, t, v, call, R, Q).alias("delta"), bs_gamma(s, k, t, v, R, Q).alias("gamma"), bs_vega(s, k, t, v, R, Q).alias("vega"))
    delta, gamma, vega = bachelier_greeks(s, k, t, v, call, R, Q)
    normal = F.struct(F.lit("normal").alias("model"), delta.alias("delta"), gamma.alias("gamma"), vega.alias("vega"))
    x = c.select("run_id", "dte", "strike", "is_call", F.inline(F.array(lognormal, normal)))
    moving = under_heston(c, money_slices(c)).select("run_id", "dte", "strike", "is_call", F.lit("heston").alias("model"), "delta", "gamma", "vega")
    x = x.unionAll(moving)
    return x.select("run_id", "dte", "strike", "is_call", "model", js_round(F.col("delta"), 6).alias("delta"), js_round(F.col("gamma"), 9).alias("gamma"), js_round(F.col("vega"), 4).alias("vega"))


#: Contracts whose price hardly moves with volatility have no implied one.
LEAST_VEGA = 0.01


@query(f"""WITH {CONTRACTS_SQL}, v AS (SELECT *, spot * {sql_pdf('d1')} * sqrt(tau) AS vega, spot * {sql_cdf('d1')} - strike * exp(-0.045e0 * tau) * {sql_cdf('(d1 - iv * sqrt(tau))')} AS call FROM contracts)
SELECT run_id, dte, strike, is_call, {sql_round('CASE WHEN is_call THEN call ELSE call - spot + strike * exp(-0.045e0 * tau) END', 4)} AS price, {sql_round(f'CASE WHEN vega >= {LEAST_VEGA!r}::DOUBLE THEN iv END', 5)} AS implied_volatility FROM v""")
def implied_volatilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contract's volatility found back from its price alone; null where the price says nothing of it."""
    s, k, t, call = (F.col(x) for x in ("spot", "strike", "tau", "is_call"))
    p = contracts(spark, sf_dir).select("run_id", "dte", "spot", "strike", "tau", "is_call", bs_price(s, k, t, F.col("iv"), call).alias("price"))
    p = p.withColumn("v", implied_volatility(F.col("price"), s, k, t, call))
    known = F.when(bs_vega(s, k, t, F.col("v")) >= F.lit(LEAST_VEGA), F.col("v"))
    return p.select("run_id", "dte", "strike", "is_call", js_round(F.col("price"), 4).alias("price"), js_round(known, 5).alias("implied_volatility"))


@query()
def calibrated_heston_greeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, delta, gamma and vega of the calls on every strike under the stochastic volatility that fits its slice, with the fit's error."""
    c = contracts(spark, sf_dir)
    p = fitted_models(slices(spark, sf_dir), ("heston",)).withColumn("years", F.col("dte") / F.lit(365.0))
    p = p.select("run_id", "dte", F.col("years").alias("tau"), *(F.col("params")[i].alias(n) for i, n in enumerate(("v0", "kappa", "theta", "xi", "rho"))), "rmse_vol")
    g = heston_greeks(c.withColumn("tau", F.col("dte") / F.lit(365.0)), p, ["run_id", "dte"], R, Q)
    return g.join(p.select("run_id", "dte", "rmse_vol"), ["run_id", "dte"])


#: The grid of log-moneyness: fiftieths from -10 to 10.
GRID = 10

SURFACE_SQL = f"""{CONTRACTS_SQL}, obs AS (SELECT run_id, dte, spot, ln(strike / spot) AS k, iv FROM contracts WHERE (strike >= spot) = is_call AND abs(ln(strike / spot)) <= 0.2e0),
cell AS (SELECT run_id, dte, spot, i / 5e1 AS x, max(k) FILTER (k <= i / 5e1) AS k0, max_by(iv, k) FILTER (k <= i / 5e1) AS v0, min(k) FILTER (k >= i / 5e1) AS k1, min_by(iv, k) FILTER (k >= i / 5e1) AS v1 FROM obs, (SELECT unnest(generate_series(-{GRID}, {GRID})) AS i) GROUP BY ALL),
vol AS (SELECT run_id, dte, spot, x, dte / 365e0 AS t, CASE WHEN k0 IS NULL THEN v1 WHEN k1 IS NULL THEN v0 WHEN k1 > k0 THEN v0 * (1 - (x - k0) / (k1 - k0)) + v1 * ((x - k0) / (k1 - k0)) ELSE v0 END AS iv FROM cell),
d AS (SELECT *, (-x + ({R - Q!r}::DOUBLE + 0.5e0 * iv * iv) * t) / (iv * sqrt(t)) AS d1, exp(-{Q!r}::DOUBLE * t) AS dq FROM vol)"""
D2 = "(d1 - iv * sqrt(t))"


@query(f"""WITH {SURFACE_SQL} SELECT run_id, dte, {sql_round('x', 4)} AS k, {sql_round('iv', 6)} AS iv, {sql_round(f'-dq * {sql_pdf("d1")} * {D2} / iv', 6)} AS vanna, {sql_round(f'spot * dq * {sql_pdf("d1")} * sqrt(t) * d1 * {D2} / iv', 3)} AS volga,
  {sql_round(f'-dq * {sql_pdf("d1")} * ({2 * (R - Q)!r}::DOUBLE * t - {D2} * iv * sqrt(t)) / (2e0 * t * iv * sqrt(t))', 6)} AS charm FROM d""")
def greek_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vanna, volga and charm (per unit of volatility and per year, before the carry of the delta itself) over expirations and 21 moneyness levels.

    Volatility is interpolated between the out-of-the-money quotes within 20 % and
    held at its ends. A quote explodes to the grid and the nearest ones on either
    side are partially aggregated, so no join is needed.
    """
    c = contracts(spark, sf_dir).withColumn("k", F.log(F.col("strike") / F.col("spot")))
    otm = ((F.col("strike") >= F.col("spot")) == F.col("is_call")) & (F.abs("k") <= 0.2)
    x = c.where(otm).select("run_id", "dte", "spot", "k", "iv", F.explode(F.sequence(F.lit(-GRID), F.lit(GRID))).alias("i")).withColumn("x", F.col("i") / F.lit(50.0))
    quote = F.struct("k", "iv")
    cell = x.groupBy("run_id", "dte", "spot", "x").agg(F.max(F.when(F.col("k") <= F.col("x"), quote)).alias("lo"), F.min(F.when(F.col("k") >= F.col("x"), quote)).alias("hi"))
    w = (F.col("x") - F.col("lo.k")) / (F.col("hi.k") - F.col("lo.k"))
    iv = F.when(F.col("lo").isNull(), F.col("hi.iv")).when(F.col("hi").isNull(), F.col("lo.iv")).when(F.col("hi.k") > F.col("lo.k"), F.col("lo.iv") * (1 - w) + F.col("hi.iv") * w).otherwise(F.col("lo.iv"))
    v = cell.select("run_id", "dte", "spot", "x", (F.col("dte") / F.lit(365.0)).alias("t"), iv.alias("iv"))
    args = (F.col("spot"), F.col("spot") * F.exp("x"), F.col("t"), F.col("iv"), R, Q)
    return v.select("run_id", "dte", js_round(F.col("x"), 4).alias("k"), js_round(F.col("iv"), 6).alias("iv"), js_round(bs_vanna(*args) * 100, 6).alias("vanna"), js_round(bs_volga(*args), 3).alias("volga"), js_round(bs_charm(*args) * 365, 6).alias("charm"))


@query(f"SELECT p_partkey, (p_partkey % 60 + 1) / 4e0 AS x, {sql_round('lgamma((p_partkey % 60 + 1) / 4e0)', 7)} AS log_gamma FROM part")
def gamma_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of the gamma function at quarters, as columns."""
    x = (F.col("p_partkey") % 60 + 1) / F.lit(4.0)
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), js_round(log_gamma(x), 7).alias("log_gamma"))


@query()
def ssvi_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One three-parameter surface for all expirations of a run, its error and arbitrage checks; a run is a listing, and so bounded."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"run_id": key[0], **fitted} for fitted in [surface.fit_ssvi(g["dte"].to_numpy() / 365, np.log(g["strike"].to_numpy() / g["spot"].to_numpy()), g["iv"].to_numpy())] if fitted], columns=["run_id", *surface.SSVI_FIELDS])

    return own_tasks(slices(spark, sf_dir), "run_id").groupBy("run_id").applyInPandas(run, "run_id int, expirations int, rho double, eta double, gamma double, rmse_iv double, calendar_ok boolean, butterfly_most double, butterfly_ok boolean, converged boolean")


#: Slices that say something about the skew at the money: older than five days and fitted well.
LEAST_YEARS, MOST_RMSE = 5 / 365, 0.015


def skew_law(p: DataFrame) -> DataFrame:
    """run_id, slices, slope, hurst, level, r2 of log |skew| over log years, from smile parameters (run_id, dte, a, b, rho, m, sigma, rmse_iv).

    A run with fewer than three slices that are fitted well has no law: nulls.
    """
    t = F.col("dte") / F.lit(365.0)
    root = F.sqrt(F.col("m") * F.col("m") + F.col("sigma") * F.col("sigma"))
    w0 = F.col("a") - F.col("b") * F.col("rho") * F.col("m") + F.col("b") * root
    skew = F.abs(F.col("b") * (F.col("rho") - F.col("m") / root) / (F.lit(2.0) * F.sqrt(t * F.col("w0"))))
    x = p.where((t > LEAST_YEARS) & (F.col("rmse_iv") <= MOST_RMSE)).withColumn("w0", w0).where("w0 > 0").select("run_id", F.log(t).alias("x"), skew.alias("s")).where("s > 0").withColumn("y", F.log("s"))
    g = x.groupBy("run_id").agg(F.count("*").alias("slices"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("at_one"), F.regr_r2("y", "x").alias("r2"))
    g = p.select("run_id").distinct().join(g, "run_id", "left")
    law = {"slope": F.col("slope"), "hurst": F.col("slope") + 0.5, "level": F.exp("at_one"), "r2": F.col("r2")}
    return g.select("run_id", F.coalesce("slices", F.lit(0)).alias("slices"), *(F.when(F.col("slices") >= 3, e).alias(n) for n, e in law.items()))


@query()
def skew_power_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the skew at the money decays with maturity, and the roughness that the decay implies, per run."""
    return skew_law(svi_parameters(quoted_smiles(spark, sf_dir)))
