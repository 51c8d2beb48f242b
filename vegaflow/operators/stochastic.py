"""Greeks under stochastic volatility by inversion of characteristic functions, in columns.

The characteristic functions depend on the expiration, not on the strike: they
are computed once per slice, a row per node and probability, and joined to the
contracts by slice. Each contract then sums its nodes, partially in the tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vegaflow.functions.complex import Complex, one, staged

#: Nodes of the midpoint rule; its end is LEAST_END + END_SPREADS / (volatility * sqrt(years)); bump of volatility for the vega.
NODES, LEAST_END, END_SPREADS, BUMP = 160, 120.0, 8.0, 0.01
#: Names of the variances at which a slice is evaluated: its own, and with the volatility moved up and down.
AT = ("", "up_", "down_")
PARAMETERS = ("v0", "kappa", "theta", "xi", "rho")


def heston_nodes(slices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, j (1: share measure, 2: bond measure), u, gap, and the characteristic functions of log(spot / forward) at variance v0 and with its root moved up and down: re, im, up_re, ..., down_im."""
    v0, kappa, theta, xi, rho, t = (F.col(c) for c in (*PARAMETERS, "tau"))
    x = slices.select(*keys, "tau", *PARAMETERS, F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))).alias("i"))
    x = x.withColumn("gap", (F.lit(LEAST_END) + F.lit(END_SPREADS) / F.sqrt(v0 * t)) / F.lit(float(NODES)))
    x = x.withColumn("u", (F.col("i") + F.lit(0.5)) * F.col("gap")).withColumn("j", F.explode(F.array(F.lit(1), F.lit(2))))
    u, share = F.col("u"), F.col("j") == 1
    x, beta = staged(x, "beta", Complex(F.when(share, kappa - rho * xi).otherwise(kappa), -rho * xi * u))
    sign = F.when(share, F.lit(-1.0)).otherwise(F.lit(1.0))
    x, d = staged(x, "d", Complex(beta.re * beta.re - beta.im * beta.im + xi * xi * u * u, F.lit(2.0) * beta.re * beta.im + sign * xi * xi * u))
    x, d = staged(x, "root", d.sqrt())
    low = beta - d
    x, g = staged(x, "g", low / (beta + d))
    x, e = staged(x, "e", d.times(-t).exp())
    x, rest = staged(x, "rest", one() - g * e)
    x, ratio = staged(x, "ratio", rest / (one() - g))
    x, a = staged(x, "a", (low.times(t) - ratio.log().times(F.lit(2.0))).times(kappa * theta / (xi * xi)))
    x, b = staged(x, "b", low.times(1 / (xi * xi)) * ((one() - e) / rest))
    values = (v0, (F.sqrt(v0) + BUMP) * (F.sqrt(v0) + BUMP), F.greatest((F.sqrt(v0) - BUMP) * (F.sqrt(v0) - BUMP), F.lit(1e-8)))
    for name, v in zip(AT, values, strict=True):
        z = (a + b.times(v)).exp()
        x = x.withColumns({f"{name}re": z.re, f"{name}im": z.im})
    return x.select(*keys, "j", "u", "gap", *(f"{n}{c}" for n in AT for c in ("re", "im")))


def heston_greeks(contracts: DataFrame, slices: DataFrame, keys: list[str], r: float, q: float) -> DataFrame:
    """keys, strike, price, delta, gamma, vega of the calls on each strike.

    ``contracts``: keys, strike, spot, tau; ``slices``: keys, tau and the five
    parameters. Delta and gamma are the derivatives themselves, vega is the
    difference for a move of the volatility of ``BUMP`` both ways.
    """
    s, k, t = F.col("spot"), F.col("strike"), F.col("tau")
    # a stated number of partitions: by bytes alone adaptive execution would give all this work to one task
    tasks = 8 * contracts.sparkSession.sparkContext.defaultParallelism
    quotes = contracts.select(*keys, "strike", "spot", "tau").distinct().repartition(tasks, *keys)
    x = quotes.join(heston_nodes(slices, keys).repartition(tasks, *keys), keys).withColumn("phase", F.col("u") * (F.log(s / k) + F.lit(float(r - q)) * t))
    sin, cos, share = F.sin("phase"), F.cos("phase"), F.col("j") == 1

    weight = F.col("gap") / F.lit(math.pi)
    part = lambda n: (cos * F.col(f"{n}im") + sin * F.col(f"{n}re")) / F.col("u") * weight
    # in a projection of its own, where the sine and cosine of a row are computed once
    x = x.select(*keys, "strike", "spot", "tau", "j", *(part(n).alias(f"{n}part") for n in AT), (F.when(share, cos * F.col("re") - sin * F.col("im")) * weight).alias("slope"))
    own = [F.sum(F.when(F.col("j") == j, F.col(f"{n}part"))).alias(f"{n}p{j}") for n in AT for j in (1, 2)]
    g = x.groupBy(*keys, "strike", "spot", "tau").agg(*own, F.sum("slope").alias("slope"))
    carry, bond = F.exp(F.lit(float(-q)) * t), F.exp(F.lit(float(-r)) * t)
    price = lambda n: s * carry * (F.lit(0.5) + F.col(f"{n}p1")) - k * bond * (F.lit(0.5) + F.col(f"{n}p2"))
    return g.select(*keys, "strike", price("").alias("price"), (carry * (F.lit(0.5) + F.col("p1"))).alias("delta"), (carry * F.col("slope") / s).alias("gamma"), ((price("up_") - price("down_")) / F.lit(2 * BUMP)).alias("vega"))
