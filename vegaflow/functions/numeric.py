"""Rounding, guards and closed-form option terms as Column expressions.

All literals are doubles: a bare decimal in a Spark expression is DECIMAL and
would change results in the last digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RISK_FREE, DIVIDEND = 0.045, 0.0
INV_SQRT_2PI = 1 / math.sqrt(2 * math.pi)


def js_round(c: Column, digits: int = 0) -> Column:
    """Half toward positive infinity, as ``floor(x * 10^n + 0.5) / 10^n``; Spark's round is half away from zero."""
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)).cast("double") / scale


def to_number(c: Column) -> Column:
    """Double, or null where the text is no number or not finite."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def safe_divide(a: Column, b: Column) -> Column:
    """Null where the denominator is zero or null."""
    return F.when(b != 0, a / b)


def norm_pdf(x: Column) -> Column:
    return F.lit(INV_SQRT_2PI) * F.exp(F.lit(-0.5) * x * x)


#: The five-term rational approximation 26.2.17 of the normal distribution.
AS_P, AS_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def norm_cdf(x: Column) -> Column:
    """Normal distribution by formula 26.2.17 of Abramowitz and Stegun (error under 7.5e-8)."""
    return _upper(x, F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * F.abs(x)), norm_pdf(x))


def _upper(x: Column, k: Column, density: Column) -> Column:
    poly = F.lit(0.0)
    for b in reversed(AS_B):
        poly = k * (F.lit(b) + poly)
    upper = density * poly
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)


def bs_d1(s: Column, k: Column, t: Column, sigma: Column, r: float = RISK_FREE, q: float = DIVIDEND) -> Column:
    return (F.log(s / k) + (F.lit(float(r - q)) + F.lit(0.5) * sigma * sigma) * t) / (sigma * F.sqrt(t))


def bs_price(s: Column, k: Column, t: Column, sigma: Column, is_call: Column, r: float = RISK_FREE, q: float = DIVIDEND) -> Column:
    d1 = bs_d1(s, k, t, sigma, r, q)
    d2 = d1 - sigma * F.sqrt(t)
    forward, strike = s * F.exp(F.lit(float(-q)) * t), k * F.exp(F.lit(float(-r)) * t)
    call = forward * norm_cdf(d1) - strike * norm_cdf(d2)
    return F.when(is_call, call).otherwise(call - forward + strike)


def bs_delta(s: Column, k: Column, t: Column, sigma: Column, is_call: Column, r: float = RISK_FREE, q: float = DIVIDEND) -> Column:
    n = norm_cdf(bs_d1(s, k, t, sigma, r, q))
    return F.exp(F.lit(float(-q)) * t) * F.when(is_call, n).otherwise(n - 1)


def bs_gamma(s: Column, k: Column, t: Column, sigma: Column, r: float = RISK_FREE, q: float = DIVIDEND) -> Column:
    return F.exp(F.lit(float(-q)) * t) * norm_pdf(bs_d1(s, k, t, sigma, r, q)) / (s * sigma * F.sqrt(t))


def bs_vega(s: Column, k: Column, t: Column, sigma: Column, r: float = RISK_FREE, q: float = DIVIDEND) -> Column:
    return s * F.exp(F.lit(float(-q)) * t) * norm_pdf(bs_d1(s, k, t, sigma, r, q)) * F.sqrt(t)


def bs_vanna(s: Column, k: Column, t: Column, sigma: Column, r: float = RISK_FREE, q: float = DIVIDEND) -> Column:
    """Change of delta for one volatility point."""
    d1 = bs_d1(s, k, t, sigma, r, q)
    return -F.exp(F.lit(float(-q)) * t) * norm_pdf(d1) * (d1 - sigma * F.sqrt(t)) / sigma / F.lit(100.0)


def bs_charm(s: Column, k: Column, t: Column, sigma: Column, r: float = RISK_FREE, q: float = DIVIDEND) -> Column:
    """Change of delta for one calendar day."""
    d1, root = bs_d1(s, k, t, sigma, r, q), sigma * F.sqrt(t)
    core = F.exp(F.lit(float(-q)) * t) * norm_pdf(d1) * (F.lit(2.0 * (r - q)) * t - (d1 - root) * root) / (F.lit(2.0) * t * root)
    return -core / F.lit(365.0)


def bs_volga(s: Column, k: Column, t: Column, sigma: Column, r: float = RISK_FREE, q: float = DIVIDEND) -> Column:
    d1 = bs_d1(s, k, t, sigma, r, q)
    return bs_vega(s, k, t, sigma, r, q) * d1 * (d1 - sigma * F.sqrt(t)) / sigma


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; inside folds, which are not compiled, a repeated expression is a repeated computation."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Bracket of implied volatilities, steps of the search, and the error (as a share of spot) at which it stops.
LEAST_VOL, MOST_VOL, VOL_STEPS, PRICE_TOL = 1e-4, 5.0, 60, 1e-14


def implied_volatility(price: Column, s: Column, k: Column, t: Column, is_call: Column, r: float = RISK_FREE, q: float = DIVIDEND) -> Column:
    """Volatility at which the closed form gives the price; null where no volatility of the bracket does.

    A fold over a bounded number of steps: Newton's step from the present guess
    where it stays within the bracket, else the middle of it; every step narrows
    the bracket by the sign of its error.
    """
    forward, strike = s * F.exp(F.lit(float(-q)) * t), k * F.exp(F.lit(float(-r)) * t)
    call = F.when(is_call, price).otherwise(price + forward - strike)
    slack = F.lit(PRICE_TOL) * s

    def cdf(x: Column) -> Column:
        return let(F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * F.abs(x)), lambda y: _upper(x, y, norm_pdf(x)))

    def seen(lo: Column, hi: Column, v: Column) -> Column:
        """lo, hi, v, error of the price at v, and vega."""

        def at(d: Column, v: Column) -> Column:
            value = forward * cdf(d) - strike * cdf(d - v * F.sqrt(t))
            return F.struct(lo.alias("lo"), hi.alias("hi"), v.alias("v"), (value - call).alias("e"), (forward * norm_pdf(d) * F.sqrt(t)).alias("g"))

        return let(v, lambda v: let(bs_d1(s, k, t, v, r, q), lambda d: at(d, v)))

    def narrowed(a: Column, _: Column) -> Column:
        lo, hi = F.when(a["e"] < 0, a["v"]).otherwise(a["lo"]), F.when(a["e"] < 0, a["hi"]).otherwise(a["v"])
        newton = a["v"] - a["e"] / a["g"]
        inside = (a["g"] > F.lit(1e-10)) & (newton > lo) & (newton < hi)
        return F.when((F.abs(a["e"]) <= slack) | (a["hi"] - a["lo"] < F.lit(1e-15)), a).otherwise(seen(lo, hi, F.when(inside, newton).otherwise((lo + hi) / F.lit(2.0))))

    start = seen(F.lit(LEAST_VOL), F.lit(MOST_VOL), F.lit(0.25))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(VOL_STEPS)), start, narrowed, lambda a: a["v"])
    most = bs_price(s, k, t, F.lit(MOST_VOL), F.lit(True), r, q)
    return F.when((call > F.greatest(forward - strike, F.lit(0.0))) & (call < most), found)


def bachelier_greeks(s: Column, k: Column, t: Column, sigma: Column, is_call: Column, r: float = RISK_FREE, q: float = DIVIDEND) -> tuple[Column, Column, Column]:
    """(delta, gamma, vega per unit of lognormal volatility) under a normal spot whose volatility is ``sigma`` times the forward."""
    forward = s * F.exp(F.lit(float(r - q)) * t)
    spread = sigma * forward * F.sqrt(t)
    d = (forward - k) / spread
    carry = F.exp(F.lit(float(-q)) * t)
    n = norm_cdf(d)
    return carry * F.when(is_call, n).otherwise(n - 1), carry * norm_pdf(d) / spread, forward * F.exp(F.lit(float(-r)) * t) * norm_pdf(d) * F.sqrt(t)


#: Bernoulli terms B(2k) / (2k (2k - 1)) of Stirling's series.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of positive numbers: Stirling's series at x + 8, carried back by the recurrence."""
    y = x + F.lit(8.0)
    series = F.lit(0.0)
    for c in reversed(STIRLING):
        series = F.lit(c) + series / (y * y)
    top = (y - F.lit(0.5)) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series / y
    below = x
    for i in range(1, 8):
        below = below * (x + F.lit(float(i)))
    return top - F.log(below)


def year_fraction(days: Column) -> Column:
    """Days over 365.25, at least one day of a 365-day year."""
    return F.when(days <= 0, F.lit(1 / 365.0)).otherwise(days.cast("double") / F.lit(365.25))


def symlog(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))
