"""Prices and smiles whose models have closed forms: smiles rebuilt from three quotes, jumps of diffusions, the law of the skew of a given surface."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.numeric import LEAST_VOL, MOST_VOL, bs_delta, bs_price, bs_vega, implied_volatility, js_round, let, norm_cdf, norm_pdf
from vegaflow.plans.modelled import SURFACE_SQL, slices, surface_df
from vegaflow.plans.registry import query
from vegaflow.plans.risk import LEAST_VEGA, LEAST_YEARS, Q, R, skew_law
from vegaflow.sources.fixtures import CONTRACTS_SQL, contracts, sql_cdf, sql_pdf, sql_round

#: Delta of the outer two quotes that a smile is rebuilt from, steps of the grid on which they are sought, and halvings that SQL takes to find a volatility.
WING, STEPS, HALVINGS = 0.25, 200, 60


def sql_d1(strike: str, vol: str) -> str:
    return f"((ln(spot / {strike}) + ({R - Q!r}::DOUBLE + 0.5e0 * {vol} * {vol}) * t) / ({vol} * sqrt(t)))"


def sql_call(strike: str, vol: str) -> str:
    d = sql_d1(strike, vol)
    return f"(spot * exp(-{Q!r}::DOUBLE * t) * {sql_cdf(d)} - {strike} * exp(-{R!r}::DOUBLE * t) * {sql_cdf(f'({d} - {vol} * sqrt(t))')})"


def sql_cost(i: int, others: tuple[int, int]) -> str:
    """What quote i adds to the flat price: its share of the vega times what it costs above the flat volatility."""
    a, b = others
    share = f"({sql_pdf(sql_d1('strike', 'v2'))} / {sql_pdf(sql_d1(f'k{i}', 'v2'))} * ln(k{a} / strike) * ln(k{b} / strike) / (ln(k{a} / k{i}) * ln(k{b} / k{i})))"
    return f"{share} * ({sql_call(f'k{i}', f'v{i}')} - {sql_call(f'k{i}', 'v2')})"


def vanna_volga_price(s: Column, k: Column, t: Column, pivots: list[Column], vols: list[Column]) -> Column:
    """Call price at the middle quote's volatility, plus the outer quotes' cost of matching vega, vanna and volga.

    Of the three equations for the shares the closed solution is taken: vanna
    and volga over vega are linear and quadratic in the log strike.
    """
    flat, call = vols[1], F.lit(True)
    price = bs_price(s, k, t, flat, call, R, Q)
    for i in (0, 2):
        own, (a, b) = pivots[i], (pivots[j] for j in range(3) if j != i)
        share = bs_vega(s, k, t, flat, R, Q) / bs_vega(s, own, t, flat, R, Q) * F.log(a / k) * F.log(b / k) / (F.log(a / own) * F.log(b / own))
        price = price + share * (bs_price(s, own, t, vols[i], call, R, Q) - bs_price(s, own, t, flat, call, R, Q))
    return price


def wings(q: DataFrame) -> DataFrame:
    """run_id, dte, p1 and p3: struct (off, strike, iv) of the put and the call nearest to the wing's delta on a grid over the slice.

    A quote explodes to the grid's points between it and the next one, where
    volatility is linear in the log strike; the nearest points are then
    partially aggregated.
    """
    by_strike, slice_ = Window.partitionBy("run_id", "dte").orderBy("strike"), Window.partitionBy("run_id", "dte")
    q = q.withColumns({"k": F.lead("strike").over(by_strike), "v": F.lead("iv").over(by_strike), "lo": F.min("strike").over(slice_), "hi": F.max("strike").over(slice_)}).where("k is not null")
    place = lambda x: (x - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(STEPS))
    q = q.withColumn("i", F.explode(F.sequence(F.floor(place(F.col("strike"))) - 1, F.ceil(place(F.col("k"))) + 1))).where((F.col("i") >= 0) & (F.col("i") <= STEPS))
    q = q.withColumn("x", F.col("lo") + F.col("i") / F.lit(float(STEPS)) * (F.col("hi") - F.col("lo"))).where((F.col("x") >= F.col("strike")) & ((F.col("x") < F.col("k")) | ((F.col("i") == STEPS) & (F.col("k") == F.col("hi")))))
    s, x, t = F.col("spot"), F.col("x"), F.col("t")
    w = F.log(x / F.col("strike")) / F.log(F.col("k") / F.col("strike"))
    q = q.withColumn("vol", F.col("iv") * (F.lit(1.0) - w) + F.col("v") * w)
    forward = s * F.exp(F.lit(R - Q) * t)

    def nearest(is_call: bool) -> Column:
        off = F.abs(bs_delta(s, x, t, F.col("vol"), F.lit(is_call), R, Q) - F.lit(WING if is_call else -WING))
        return F.min(F.when((x >= forward) if is_call else (x <= forward), F.struct(off.alias("off"), x.alias("strike"), F.col("vol").alias("iv"))))

    return q.groupBy("run_id", "dte").agg(nearest(False).alias("p1"), nearest(True).alias("p3"))


PUT_OFF = f"abs(exp(-{Q!r}::DOUBLE * t) * ({sql_cdf(sql_d1('x', 'vol'))} - 1) + {WING!r}::DOUBLE)"
CALL_OFF = f"abs(exp(-{Q!r}::DOUBLE * t) * {sql_cdf(sql_d1('x', 'vol'))} - {WING!r}::DOUBLE)"


@query(f"""WITH RECURSIVE {CONTRACTS_SQL}, q AS (SELECT run_id, dte, spot, strike, iv, dte / 365e0 AS t, lead(strike) OVER w AS k, lead(iv) OVER w AS v, min(strike) OVER s AS lo, max(strike) OVER s AS hi FROM contracts WHERE (strike >= spot) = is_call AND abs(ln(strike / spot)) <= 0.25e0
  WINDOW w AS (PARTITION BY run_id, dte ORDER BY strike), s AS (PARTITION BY run_id, dte)),
g AS (SELECT run_id, dte, spot, t, x, spot * exp({R - Q!r}::DOUBLE * t) AS f, iv * (1 - ln(x / strike) / ln(k / strike)) + v * (ln(x / strike) / ln(k / strike)) AS vol FROM (SELECT q.*, i, lo + i / {STEPS}e0 * (hi - lo) AS x FROM q, (SELECT unnest(generate_series(0, {STEPS})) AS i) n WHERE k IS NOT NULL) c WHERE x >= strike AND (x < k OR (i = {STEPS} AND k = hi))),
w AS (SELECT run_id, dte, min({{'off': {PUT_OFF}, 'strike': x, 'iv': vol}}) FILTER (x <= f) AS p1, min({{'off': {CALL_OFF}, 'strike': x, 'iv': vol}}) FILTER (x >= f) AS p3 FROM g GROUP BY 1, 2),
m AS (SELECT run_id, dte, min({{'off': abs(strike - spot * exp({R - Q!r}::DOUBLE * t)), 'strike': strike, 'iv': iv}}) AS p2 FROM q GROUP BY 1, 2),
x AS (SELECT q.run_id, q.dte, spot, strike, iv, t, p1.strike AS k1, p2.strike AS k2, p3.strike AS k3, p1.iv AS v1, p2.iv AS v2, p3.iv AS v3 FROM q JOIN w USING (run_id, dte) JOIN m USING (run_id, dte) WHERE p1.strike < p2.strike AND p2.strike < p3.strike),
y AS (SELECT run_id, dte, spot, strike, iv, t, k1, k2, k3, {sql_call('strike', 'v2')} + {sql_cost(1, (2, 3))} + {sql_cost(3, (1, 2))} AS price FROM x),
f(run_id, dte, strike, spot, t, price, iv, k1, k2, k3, lo, hi, i) AS (SELECT run_id, dte, strike, spot, t, price, iv, k1, k2, k3, {LEAST_VOL!r}::DOUBLE, {MOST_VOL!r}::DOUBLE, 0 FROM y UNION ALL
  SELECT run_id, dte, strike, spot, t, price, iv, k1, k2, k3, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, i + 1 FROM (SELECT *, {sql_call('strike', 'mid')} < price AS below FROM (SELECT *, (lo + hi) / 2 AS mid FROM f WHERE i < {HALVINGS}) g) h),
z AS (SELECT *, price > greatest(spot * exp(-{Q!r}::DOUBLE * t) - strike * exp(-{R!r}::DOUBLE * t), 0) AND price < {sql_call('strike', f'{MOST_VOL!r}::DOUBLE')} AND spot * exp(-{Q!r}::DOUBLE * t) * sqrt(t) * {sql_pdf(sql_d1('strike', 'lo'))} >= {LEAST_VEGA!r}::DOUBLE AS known FROM f WHERE i = {HALVINGS})
SELECT run_id, dte, {sql_round('k1', 4)} AS put_strike, k2 AS money_strike, {sql_round('k3', 4)} AS call_strike, count(*) AS quotes, count(*) FILTER (known) AS n, {sql_round('sqrt(avg((lo - iv) * (lo - iv)) FILTER (known))', 6)} AS rmse_vol FROM z GROUP BY run_id, dte, k1, k2, k3""")
def vanna_volga_smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smile of each slice rebuilt from its quote at the money and the 25-delta put and call, and its error over the slice's own quotes.

    ``n`` of the slice's ``quotes`` have a rebuilt price that says something of
    the volatility. A slice whose three strikes do not ascend gives no row.
    """
    q = slices(spark, sf_dir).withColumn("t", F.col("dte") / F.lit(365.0))
    s, k, t = F.col("spot"), F.col("strike"), F.col("t")
    money = F.struct(F.abs(k - s * F.exp(F.lit(R - Q) * t)).alias("off"), "strike", "iv")
    x = q.withColumn("p2", F.min(money).over(Window.partitionBy("run_id", "dte"))).join(wings(q), ["run_id", "dte"])
    x = x.where((F.col("p1.strike") < F.col("p2.strike")) & (F.col("p2.strike") < F.col("p3.strike")))
    names = ("p1", "p2", "p3")
    x = x.withColumn("price", vanna_volga_price(s, k, t, [F.col(f"{p}.strike") for p in names], [F.col(f"{p}.iv") for p in names]))
    x = x.withColumn("v", implied_volatility(F.col("price"), s, k, t, F.lit(True), R, Q))
    x = x.withColumn("v", F.when(bs_vega(s, k, t, F.col("v"), R, Q) >= F.lit(LEAST_VEGA), F.col("v")))
    off = F.col("v") - F.col("iv")
    g = x.groupBy("run_id", "dte", F.col("p1.strike").alias("k1"), F.col("p2.strike").alias("money_strike"), F.col("p3.strike").alias("k3")).agg(F.count("*").alias("quotes"), F.count("v").alias("n"), js_round(F.sqrt(F.avg(off * off)), 6).alias("rmse_vol"))
    return g.select("run_id", "dte", js_round(F.col("k1"), 4).alias("put_strike"), "money_strike", js_round(F.col("k3"), 4).alias("call_strike"), "quotes", "n", "rmse_vol")


#: Jumps a year, mean and deviation of a jump of the logarithm, and the most jumps that a term stands for.
JUMPS, JUMP_MEAN, JUMP_DEV, MOST_JUMPS = 0.8, -0.08, 0.12, 32
#: Logarithm of the mean factor of a jump, and jumps a year under the measure in which that factor is one.
FACTOR = JUMP_MEAN + JUMP_DEV**2 / 2
TILTED = JUMPS * math.exp(FACTOR)
DRIFT = R - JUMPS * (math.exp(FACTOR) - 1)


def merton(s: Column, k: Column, t: Column, sigma: Column) -> Column:
    """Struct of price, delta and gamma of a call under a diffusion with lognormal jumps.

    Given n jumps the logarithm is normal, so each is a mean of closed forms
    weighted by a Poisson law; a fold carries the weight from one n to the next.
    """

    def term(acc: Column, n: Column) -> Column:
        var = sigma * sigma * t + n * F.lit(JUMP_DEV**2)

        def with_root(root: Column) -> Column:
            d = (F.log(s / k) + F.lit(DRIFT - Q) * t + n * F.lit(FACTOR)) / root + root / F.lit(2.0)
            return let(d, lambda d: added(d, root))

        def added(d: Column, root: Column) -> Column:
            carry = F.exp(-F.lit(Q) * t)
            price = s * carry * norm_cdf(d) - k * F.exp(-F.lit(DRIFT) * t - n * F.lit(FACTOR)) * norm_cdf(d - root)
            w = acc["w"]
            return F.struct((w * F.lit(TILTED) * t / (n + F.lit(1.0))).alias("w"), (acc["price"] + w * price).alias("price"), (acc["delta"] + w * carry * norm_cdf(d)).alias("delta"), (acc["gamma"] + w * carry * norm_pdf(d) / (s * root)).alias("gamma"))

        return let(F.sqrt(var), with_root)

    zero = F.lit(0.0)
    start = F.struct(F.exp(-F.lit(TILTED) * t).alias("w"), zero.alias("price"), zero.alias("delta"), zero.alias("gamma"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(MOST_JUMPS)), lambda n: n.cast("double")), start, term)


JUMP_D = f"((ln(spot / strike) + {DRIFT - Q!r}::DOUBLE * t + n * {FACTOR!r}::DOUBLE) / root + root / 2)"
CARRY = f"exp(-{Q!r}::DOUBLE * t)"


@query(f"""WITH {CONTRACTS_SQL}, j AS (SELECT run_id, dte, strike, is_call, spot, t, n, exp(-{TILTED!r}::DOUBLE * t) * pow({TILTED!r}::DOUBLE * t, n) / CAST(factorial(n) AS DOUBLE) AS w, sqrt(iv * iv * t + n * {JUMP_DEV**2!r}::DOUBLE) AS root
  FROM (SELECT *, dte / 365e0 AS t FROM contracts), (SELECT CAST(unnest(generate_series(0, {MOST_JUMPS})) AS INTEGER) AS n)),
g AS (SELECT run_id, dte, strike, is_call, spot, t, sum(w * (spot * {CARRY} * {sql_cdf(JUMP_D)} - strike * exp(-{DRIFT!r}::DOUBLE * t - n * {FACTOR!r}::DOUBLE) * {sql_cdf(f'({JUMP_D} - root)')})) AS price, sum(w * {CARRY} * {sql_cdf(JUMP_D)}) AS delta, sum(w * {CARRY} * {sql_pdf(JUMP_D)} / (spot * root)) AS gamma FROM j GROUP BY ALL)
SELECT run_id, dte, strike, is_call, {sql_round(f'price - CASE WHEN is_call THEN 0e0 ELSE spot * {CARRY} - strike * exp(-{R!r}::DOUBLE * t) END', 4)} AS price, {sql_round(f'delta - CASE WHEN is_call THEN 0e0 ELSE {CARRY} END', 6)} AS delta, {sql_round('gamma', 9)} AS gamma FROM g""")
def jump_diffusion_greeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, delta and gamma of every contract under jumps of fixed law around its own volatility."""
    s, k, t, call = F.col("spot"), F.col("strike"), F.col("t"), F.col("is_call")
    x = contracts(spark, sf_dir).withColumn("t", F.col("dte") / F.lit(365.0)).select("run_id", "dte", "spot", "strike", "t", "is_call", merton(s, k, t, F.col("iv")).alias("m"))
    carry = F.exp(-F.lit(Q) * t)
    price = F.col("m.price") - F.when(call, F.lit(0.0)).otherwise(s * carry - k * F.exp(-F.lit(R) * t))
    delta = F.col("m.delta") - F.when(call, F.lit(0.0)).otherwise(carry)
    return x.select("run_id", "dte", "strike", "is_call", js_round(price, 4).alias("price"), js_round(delta, 6).alias("delta"), js_round(F.col("m.gamma"), 9).alias("gamma"))


@query(f"""WITH {SURFACE_SQL}, w AS (SELECT run_id, dte / 365e0 AS t, a - b * rho * m + b * sqrt(m * m + s * s) AS w0, b * (rho - m / sqrt(m * m + s * s)) AS up FROM surface),
l AS (SELECT run_id, ln(t) AS x, ln(abs(up / (2e0 * sqrt(t * w0)))) AS y FROM w WHERE t > {LEAST_YEARS!r}::DOUBLE AND w0 > 0 AND up <> 0)
SELECT r.run_id, count(x) AS slices, {', '.join(sql_round(f'CASE WHEN count(x) >= 3 THEN {e} END', 6) + f' AS {n}' for n, e in (('slope', 'regr_slope(y, x)'), ('hurst', 'regr_slope(y, x) + 0.5e0'), ('level', 'exp(regr_intercept(y, x))'), ('r2', 'regr_r2(y, x)')))}
FROM (SELECT DISTINCT run_id FROM surface) r LEFT JOIN l USING (run_id) GROUP BY 1""")
def level_skew_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power law of the skew at the money over the closed-form surface of every run; ``skew_power_law`` has that of the fits."""
    law = skew_law(surface_df(spark, sf_dir).withColumnRenamed("s", "sigma").withColumn("rmse_iv", F.lit(0.0)))
    return law.select("run_id", "slices", *(js_round(F.col(n), 6).alias(n) for n in ("slope", "hurst", "level", "r2")))
