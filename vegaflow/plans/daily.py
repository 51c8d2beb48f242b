"""Daily series queries: bands, realised volatility, volatility indices, rotation, seasonality."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from vegaflow.functions.numeric import js_round
from vegaflow.operators.series import band_join, mid_rank, relative_rotation, runs, split_adjusted
from vegaflow.plans.registry import query
from vegaflow.sources.fixtures import BARS30_SQL, BARS_SQL, PANEL_SQL, TERM_SQL, VIX_SQL, daily_bars, half_hour_bars, sql_round, symbol_panel, term_structure, vol_indices


def days() -> WindowSpec:
    """One series of days is bounded by the calendar; its windows run in one task by design."""
    return Window.orderBy("trading_date")


def symbol_days() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trading_date")


def latest() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(F.desc("trading_date"))



@query(f"WITH {TERM_SQL} SELECT trading_date, dte, trading_date + dte AS expiration_date, {sql_round('atm_iv', 6)} AS atm_iv FROM term")
def daily_term_structure(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """At-the-money volatility by day and days to expiration; of the days of ``orders`` only, if given."""
    return term_structure(spark, sf_dir, orders).select("trading_date", "dte", F.date_add("trading_date", F.col("dte")).alias("expiration_date"), js_round(F.col("atm_iv"), 6).alias("atm_iv"))


QUANTILES = (0.1, 0.3, 0.5, 0.7, 0.9)


@query(f"""WITH {TERM_SQL}, days AS (SELECT trading_date AS day FROM (SELECT DISTINCT trading_date FROM term) ORDER BY 1 DESC LIMIT 5),
grid AS (SELECT day, CAST(unnest(generate_series(0, 280)) AS INTEGER) AS dte FROM days)
SELECT day AS trading_date, g.dte, {', '.join(f"{sql_round(f'quantile_cont(atm_iv, {q})', 6)} AS iv_p{int(q * 100)}" for q in QUANTILES)}, count(atm_iv) AS sample_count
FROM grid g LEFT JOIN term t ON abs(t.dte - g.dte) <= CASE WHEN g.dte < 7 THEN 1 ELSE 3 END AND t.trading_date BETWEEN day - 365 AND day - 1 GROUP BY day, g.dte""")
def cloud_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bands of volatility by days to expiration, over the year before each of the last five days.

    A sample is exploded to the targets it counts for, so the band join is an
    equality on the target; the five days are a stated query set.
    """
    t = term_structure(spark, sf_dir)
    asked = t.select(F.col("trading_date").alias("day")).distinct().orderBy(F.desc("day")).limit(5)
    grid = asked.select("day", F.explode(F.sequence(F.lit(0), F.lit(280))).alias("target"))
    near = band_join(t, "dte", F.lit(3), (0, 280), "target").where((F.col("target") >= 7) | (F.abs(F.col("dte") - F.col("target")) <= 1))
    dated = near.join(F.broadcast(asked), (F.col("trading_date") < F.col("day")) & (F.col("trading_date") >= F.date_sub("day", 365)))
    bands = dated.groupBy("day", "target").agg(F.percentile("atm_iv", F.array(*map(F.lit, QUANTILES))).alias("q"), F.count("atm_iv").alias("n"))
    out = grid.join(bands, ["day", "target"], "left")
    return out.select(F.col("day").alias("trading_date"), F.col("target").alias("dte"), *(js_round(F.col("q")[i], 6).alias(f"iv_p{int(q * 100)}") for i, q in enumerate(QUANTILES)), F.coalesce("n", F.lit(0)).alias("sample_count"))


HISTORY_SQL = f"""WITH {TERM_SQL}, near AS (SELECT trading_date AS day, target, atm_iv FROM term, (SELECT unnest(generate_series(-3, 3)) AS k) o, (SELECT CAST(unnest(generate_series(0, 280)) AS INTEGER) AS target) g WHERE target = dte + k AND (target >= 7 OR abs(k) <= 1)),
stacked AS (SELECT day, target, atm_iv, false AS asked FROM near UNION ALL SELECT day, CAST(unnest(generate_series(0, 280)) AS INTEGER), NULL, true FROM (SELECT DISTINCT trading_date AS day FROM term)),
q AS (SELECT day, target, asked, {', '.join(f'quantile_cont(atm_iv, {q}) OVER w AS q{int(q * 100)}' for q in QUANTILES)}, count(atm_iv) OVER w AS n FROM stacked WINDOW w AS (PARTITION BY target ORDER BY day RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT CAST(day AS DATE) AS trading_date, target AS dte, {', '.join(f"{sql_round(f'q{int(q * 100)}', 6)} AS iv_p{int(q * 100)}" for q in QUANTILES)}, n AS sample_count FROM q WHERE asked"""


@query(HISTORY_SQL)
def cloud_bands_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of every trading day: (trading_date, dte 0..280), as the daily table is filled.

    Samples of a target are added up by day and value; one window by target over
    the 365 days before takes the percentiles. A target has at most seven samples
    a day, so a partition is bounded by the calendar.
    """
    t = term_structure(spark, sf_dir)
    near = band_join(t, "dte", F.lit(3), (0, 280), "target").where((F.col("target") >= 7) | (F.abs(F.col("dte") - F.col("target")) <= 1))
    samples = near.groupBy("trading_date", "target", "atm_iv").agg(F.count("atm_iv").alias("n"))
    grid = t.select("trading_date").distinct().select("trading_date", F.explode(F.sequence(F.lit(0), F.lit(280))).alias("target"), F.lit(None).cast("double").alias("atm_iv"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    stacked = samples.withColumn("asked", F.lit(False)).unionByName(grid).withColumn("day", F.unix_date("trading_date"))
    year = Window.partitionBy("target").orderBy("day").rangeBetween(-365, -1)
    quantiles = F.percentile("atm_iv", F.array(*map(F.lit, QUANTILES)), F.col("n")).over(year)
    out = stacked.withColumns({"q": quantiles, "sample_count": F.coalesce(F.sum("n").over(year), F.lit(0))}).where("asked")
    return out.select("trading_date", F.col("target").alias("dte"), *(js_round(F.col("q")[i], 6).alias(f"iv_p{int(q * 100)}") for i, q in enumerate(QUANTILES)), "sample_count")


YZ_K = 0.34 / (1.34 + 21 / 19)


def yang_zhang(bars: DataFrame, n: int = 20) -> DataFrame:
    """Adds hv: annualised Yang-Zhang volatility of the last ``n`` days; null before n + 1 rows or if not positive."""
    back = days().rowsBetween(-(n - 1), 0)
    x = bars.withColumns(
        {
            "_on": F.log(F.col("open") / F.lag("close").over(days())),
            "_oc": F.log(F.col("close") / F.col("open")),
            "_rs": F.log(F.col("high") / F.col("close")) * F.log(F.col("high") / F.col("open")) + F.log(F.col("low") / F.col("close")) * F.log(F.col("low") / F.col("open")),
        }
    )
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = F.var_samp("_on").over(back) + F.lit(k) * F.var_samp("_oc").over(back) + F.lit(1 - k) * F.avg("_rs").over(back)
    return x.withColumn("_var", F.when(F.count("_on").over(back) == n, var)).withColumn("hv", F.when(F.col("_var") > 0, F.sqrt(F.col("_var") * 252))).drop("_on", "_oc", "_rs", "_var")


def constant_maturity(term: DataFrame, target: int = 30) -> DataFrame:
    """trading_date, iv: total variance interpolated between the nearest maturities around ``target`` days."""
    ok = term.where((F.col("atm_iv") > 0) & (F.col("dte") > 0))
    pick = F.struct("dte", "atm_iv")
    at = ok.groupBy("trading_date").agg(
        F.max(F.when(F.col("dte") == target, F.col("atm_iv"))).alias("exact"), F.max(F.when(F.col("dte") < target, pick)).alias("lo"), F.min(F.when(F.col("dte") > target, pick)).alias("hi")
    )
    wl, wh = (F.col(f"{s}.atm_iv") * F.col(f"{s}.atm_iv") * (F.col(f"{s}.dte") / F.lit(365.0)) for s in ("lo", "hi"))
    w = wl + (wh - wl) * ((F.lit(target) - F.col("lo.dte")) / (F.col("hi.dte") - F.col("lo.dte")))
    both = F.when(w > 0, F.sqrt(w / F.lit(target / 365)))
    return at.select("trading_date", F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), both).otherwise(F.coalesce("hi.atm_iv", "lo.atm_iv")).alias("iv"))


VOL_STATS_SQL = f"""{BARS_SQL}, {TERM_SQL}, logs AS (
  SELECT *, ln(open / lag(close) OVER (ORDER BY trading_date)) AS on_, ln(close / open) AS oc, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM bars
), v AS (
  SELECT *, count(on_) OVER w AS n, var_samp(on_) OVER w + {YZ_K!r}::DOUBLE * var_samp(oc) OVER w + (1 - {YZ_K!r}::DOUBLE) * avg(rs) OVER w AS yz FROM logs
  WINDOW w AS (ORDER BY trading_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), cm AS (
  SELECT trading_date, max(atm_iv) FILTER (dte = 30) AS exact, max_by(atm_iv, dte) FILTER (dte < 30) AS lo_iv, max(dte) FILTER (dte < 30) AS lo_d, min_by(atm_iv, dte) FILTER (dte > 30) AS hi_iv, min(dte) FILTER (dte > 30) AS hi_d
  FROM term WHERE dte > 0 AND atm_iv > 0 GROUP BY 1
), cm30 AS (
  SELECT trading_date, CASE WHEN exact IS NOT NULL THEN exact WHEN lo_d IS NOT NULL AND hi_d IS NOT NULL THEN
    sqrt((lo_iv * lo_iv * (lo_d / 365e0) + (hi_iv * hi_iv * (hi_d / 365e0) - lo_iv * lo_iv * (lo_d / 365e0)) * ((30 - lo_d) / CAST(hi_d - lo_d AS DOUBLE))) / (30 / 365e0)) ELSE coalesce(hi_iv, lo_iv) END AS iv FROM cm
), stats AS (
  SELECT v.trading_date, close, CASE WHEN n = 20 AND yz > 0 THEN sqrt(yz * 252) END AS hv, iv FROM v LEFT JOIN cm30 USING (trading_date))"""


def vol_stats_of(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Bars of all days with hv, and iv; with ``orders``, days that have none among them have no iv."""
    return yang_zhang(daily_bars(spark, sf_dir)).join(constant_maturity(term_structure(spark, sf_dir, orders)), "trading_date", "left")


@query(f"WITH {VOL_STATS_SQL} SELECT trading_date, {sql_round('hv', 6)} AS hv_20d_yz, {sql_round('iv', 6)} AS iv_30d_cm, {sql_round('iv - hv', 6)} AS vrp_spread FROM stats")
def vol_stats(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Yang-Zhang volatility, constant-maturity implied volatility and their difference; with ``orders``, whole for their days only."""
    s = vol_stats_of(spark, sf_dir, orders)
    return s.select("trading_date", js_round(F.col("hv"), 6).alias("hv_20d_yz"), js_round(F.col("iv"), 6).alias("iv_30d_cm"), js_round(F.col("iv") - F.col("hv"), 6).alias("vrp_spread"))


@query(f"""WITH {VOL_STATS_SQL}, {VIX_SQL} SELECT s.trading_date, s.close AS spx_close, {sql_round('iv - hv', 6)} AS vrp_spread, x.close AS vix_close
  FROM stats s LEFT JOIN vix x ON x.trading_date = s.trading_date AND x.symbol = 'VIX' WHERE hv IS NOT NULL AND iv IS NOT NULL""")
def vrp_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility risk premium by day with the volatility index beside it."""
    v = vol_indices(spark, sf_dir).where("symbol = 'VIX'").select("trading_date", F.col("close").alias("vix_close"))
    s = vol_stats_of(spark, sf_dir).where("hv is not null and iv is not null")
    return s.join(v, "trading_date", "left").select("trading_date", F.col("close").alias("spx_close"), js_round(F.col("iv") - F.col("hv"), 6).alias("vrp_spread"), "vix_close")


@query(f"""WITH {VOL_STATS_SQL}, d AS (SELECT trading_date, round(iv - hv, 9) AS vrp FROM stats WHERE hv IS NOT NULL AND iv IS NOT NULL), l AS (SELECT *, row_number() OVER (ORDER BY trading_date DESC) AS r FROM d), y AS (SELECT * FROM l WHERE r <= 252)
SELECT max(trading_date) FILTER (r = 1) AS trading_date, {sql_round('max(vrp) FILTER (r = 1)', 6)} AS vrp, {sql_round('max(vrp) FILTER (r = 2)', 6)} AS prev_vrp,
  {sql_round('count(*) FILTER (vrp <= (SELECT vrp FROM l WHERE r = 1)) * 1e2 / count(*)', 1)} AS pct_rank_252d FROM y""")
def vrp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest and previous risk premium and the latest one's rank within a year."""
    d = vol_stats_of(spark, sf_dir).where("hv is not null and iv is not null").select("trading_date", F.round(F.col("iv") - F.col("hv"), 9).alias("vrp"))
    year = d.orderBy(F.desc("trading_date")).limit(252)
    a = year.agg(F.max("trading_date").alias("trading_date"), F.max_by("vrp", "trading_date").alias("vrp"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("trading_date", "vrp"))).alias("all"))
    # a step of its own: beside the rounded column of that name, a lambda's vrp is the rounded one
    a = a.withColumn("below", F.size(F.filter("all", lambda x: x["vrp"] <= F.col("vrp"))))
    return a.select("trading_date", js_round(F.col("vrp"), 6).alias("vrp"), js_round(F.try_element_at("all", F.lit(-2))["vrp"], 6).alias("prev_vrp"), js_round(F.col("below") * 100.0 / F.col("n"), 1).alias("pct_rank_252d"))


@query(f"""WITH {BARS_SQL}, r AS (SELECT trading_date, close, ln(close / lag(close) OVER (ORDER BY trading_date)) AS x FROM bars),
s AS (SELECT *, count(x) OVER w AS n, var_samp(x) OVER w AS v FROM r WINDOW w AS (ORDER BY trading_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT trading_date, close AS spx_close, {sql_round('CASE WHEN n = 10 AND v > 0 THEN sqrt(v * 252) END', 4)} AS hv_10d FROM s""")
def rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-day realised volatility of closes, with full windows only."""
    w = days().rowsBetween(-9, 0)
    r = daily_bars(spark, sf_dir).withColumn("x", F.log(F.col("close") / F.lag("close").over(days())))
    v = F.var_samp("x").over(w)
    return r.withColumn("v", F.when((F.count("x").over(w) == 10) & (v > 0), F.sqrt(v * 252))).select("trading_date", F.col("close").alias("spx_close"), js_round(F.col("v"), 4).alias("hv_10d"))


@query(f"""WITH {VIX_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) AS r FROM vix)
SELECT symbol, count(*) AS n, max(trading_date) FILTER (r = 1) AS latest_date, max(close) FILTER (r = 1) AS latest, max(close) FILTER (r = 2) AS prior,
  {sql_round('(max(close) FILTER (r = 1) - max(close) FILTER (r = 2)) / max(close) FILTER (r = 2) * 100', 2)} AS change_pct,
  {sql_round('count(*) FILTER (r <= 252 AND close <= (SELECT close FROM l k WHERE k.symbol = l.symbol AND k.r = 1)) * 1e2 / count(*) FILTER (r <= 252)', 1)} AS pct_rank_252d FROM l GROUP BY symbol""")
def vix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest, prior, change and one-year rank of each volatility index."""
    l = vol_indices(spark, sf_dir).withColumns({"r": F.row_number().over(latest()), "now": F.first("close").over(latest())})  # noqa: E741
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("close")))
    year = F.col("r") <= 252
    return l.groupBy("symbol").agg(
        F.count("*").alias("n"), F.max("trading_date").alias("latest_date"), at(1).alias("latest"), at(2).alias("prior"), js_round((at(1) - at(2)) / at(2) * 100, 2).alias("change_pct"), js_round(F.count_if(year & (F.col("close") <= F.col("now"))) * 100.0 / F.count_if(year), 1).alias("pct_rank_252d")
    )


REGIMES = ("calm", "normal", "elevated", "stressed")


def regime_of(c):
    return F.when(c < 12, "calm").when(c < 18, "normal").when(c < 30, "elevated").otherwise("stressed")


REGIME_SQL = "CASE WHEN close < 12 THEN 'calm' WHEN close < 18 THEN 'normal' WHEN close < 30 THEN 'elevated' ELSE 'stressed' END"


@query(f"WITH {VIX_SQL} SELECT symbol, {REGIME_SQL} AS regime, count(*) AS days, {sql_round('count(*) * 1e2 / sum(count(*)) OVER (PARTITION BY symbol)', 4)} AS share FROM vix GROUP BY 1, 2")
def vix_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each volatility regime."""
    t = vol_indices(spark, sf_dir).groupBy("symbol", regime_of(F.col("close")).alias("regime")).agg(F.count("*").alias("days"))
    return t.withColumn("share", js_round(F.col("days") * 100.0 / F.sum("days").over(Window.partitionBy("symbol")), 4))


@query(f"""WITH {VIX_SQL}, s AS (SELECT trading_date, {REGIME_SQL} AS state FROM vix WHERE symbol = 'VIX'), lags AS (SELECT unnest([1, 5, 21]) AS lag_days),
x AS (SELECT 1 AS lag_days, state, lead(state, 1) OVER (ORDER BY trading_date) AS next FROM s UNION ALL SELECT 5, state, lead(state, 5) OVER (ORDER BY trading_date) FROM s UNION ALL SELECT 21, state, lead(state, 21) OVER (ORDER BY trading_date) FROM s),
c AS (SELECT lag_days, state, next, count(*) AS n FROM x WHERE next IS NOT NULL GROUP BY ALL), r AS (SELECT unnest(['calm', 'normal', 'elevated', 'stressed']) AS name),
g AS (SELECT lag_days, p.name AS from_regime, q.name AS to_regime FROM lags, r p, r q)
SELECT g.lag_days, from_regime, to_regime, coalesce(n, 0) AS n, {sql_round('coalesce(n * 1e0 / sum(n) OVER (PARTITION BY g.lag_days, from_regime), 0e0)', 6)} AS probability
FROM g LEFT JOIN c ON c.lag_days = g.lag_days AND state = from_regime AND next = to_regime""")
def vix_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime transition probabilities at lags of 1, 5 and 21 days, on the full grid."""
    s = vol_indices(spark, sf_dir).where("symbol = 'VIX'").withColumn("state", regime_of(F.col("close")))
    led = s.select("state", *(F.lead("state", k).over(days()).alias(f"n{k}") for k in (1, 5, 21)))
    nexts = F.array(*(F.struct(F.lit(k).alias("lag_days"), F.col(f"n{k}").alias("next")) for k in (1, 5, 21)))
    c = led.select("state", F.inline(nexts)).where("next is not null").groupBy("lag_days", "state", "next").agg(F.count("*").alias("n"))
    names = F.array(*map(F.lit, REGIMES))
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 5, 21)))).alias("lag_days")).select("lag_days", F.explode(names).alias("from_regime")).select("*", F.explode(names).alias("to_regime"))
    j = grid.join(c.withColumnsRenamed({"state": "from_regime", "next": "to_regime"}), ["lag_days", "from_regime", "to_regime"], "left")
    total = F.sum("n").over(Window.partitionBy("lag_days", "from_regime"))
    return j.select("lag_days", "from_regime", "to_regime", F.coalesce("n", F.lit(0)).alias("n"), js_round(F.coalesce(F.col("n") / total, F.lit(0.0)), 6).alias("probability"))


@query(f"""WITH {VIX_SQL}, x AS (SELECT symbol, ln(close) AS x, lead(ln(close)) OVER (PARTITION BY symbol ORDER BY trading_date) AS y, last_value(close) OVER (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM vix WHERE close > 0),
f AS (SELECT symbol, max(last) AS last, count(y) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt(regr_syy(y, x) / regr_count(y, x) * (1 - regr_r2(y, x))) AS sd FROM x GROUP BY 1)
SELECT symbol, n, {sql_round('-ln(b) * 252', 4)} AS kappa, {sql_round('exp(a / (1 - b))', 4)} AS level, {sql_round('sd * sqrt(2 * -ln(b) * 252 / (1 - b * b))', 4)} AS sigma, {sql_round('ln(2) / -ln(b)', 4)} AS half_life_days,
  {sql_round('exp(a / (1 - b) + (ln(last) - a / (1 - b)) * exp(ln(b) * 21))', 4)} AS expected_21d FROM f WHERE n >= 59 AND b > 0 AND b < 1""")
def ou_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reversion of log levels fitted as a first-order autoregression, per index."""
    x = vol_indices(spark, sf_dir).where("close > 0").select("symbol", "trading_date", "close", F.log("close").alias("x"), F.lead(F.log("close")).over(symbol_days()).alias("y"))
    f = x.groupBy("symbol").agg(F.max_by("close", "trading_date").alias("last"), F.count("y").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.sqrt(F.regr_syy("y", "x") / F.regr_count("y", "x") * (1 - F.regr_r2("y", "x"))).alias("sd"))
    b, theta = F.col("b"), F.col("a") / (1 - F.col("b"))
    kappa = -F.log(b) * 252
    return f.where("n >= 59 and b > 0 and b < 1").select("symbol", "n", js_round(kappa, 4).alias("kappa"), js_round(F.exp(theta), 4).alias("level"), js_round(F.col("sd") * F.sqrt(kappa * 2 / (1 - b * b)), 4).alias("sigma"), js_round(F.lit(math.log(2)) / -F.log(b), 4).alias("half_life_days"), js_round(F.exp(theta + (F.log("last") - theta) * F.exp(F.log(b) * 21)), 4).alias("expected_21d"))


@query(f"""WITH {VIX_SQL}, g AS (SELECT *, close / first_value(close) OVER w AS growth, ln(close / lag(close) OVER w) AS ret FROM vix WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)),
p AS (SELECT *, max(growth) OVER w AS peak FROM g WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)),
d AS (SELECT *, (peak - growth) / peak AS dd FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(dd, 12) DESC, trading_date) AS r FROM d)
SELECT t.symbol, {sql_round('avg(ret) * 252', 6)} AS ann_return, {sql_round('stddev_samp(ret) * sqrt(252)', 6)} AS ann_vol, {sql_round('avg(ret) * 252 / (stddev_samp(ret) * sqrt(252))', 6)} AS sharpe,
  {sql_round('max(dd)', 6)} AS max_drawdown, max(trading_date) FILTER (r = 1) AS trough_date, (SELECT min(k.trading_date) FROM d k WHERE k.symbol = t.symbol AND k.growth = max(t.peak) FILTER (t.r = 1)) AS peak_date FROM t GROUP BY t.symbol""")
def strategy_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth statistics and the deepest drawdown of each index with its dates."""
    g = vol_indices(spark, sf_dir).withColumns({"growth": F.col("close") / F.first("close").over(symbol_days()), "ret": F.log(F.col("close") / F.lag("close").over(symbol_days()))})
    so_far = symbol_days().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.max(F.struct("growth", (-F.unix_date("trading_date")).alias("first"))).over(so_far)
    d = g.withColumn("top", top).withColumn("dd", (F.col("top.growth") - F.col("growth")) / F.col("top.growth"))
    worst = F.max(F.struct(F.round("dd", 12), (-F.unix_date("trading_date")).alias("first"), "trading_date", F.date_from_unix_date(-F.col("top.first")).alias("peak"))).alias("w")
    mean, sd = F.avg("ret") * 252, F.stddev_samp("ret") * math.sqrt(252)
    a = d.groupBy("symbol").agg(js_round(mean, 6).alias("ann_return"), js_round(sd, 6).alias("ann_vol"), js_round(mean / sd, 6).alias("sharpe"), js_round(F.max("dd"), 6).alias("max_drawdown"), worst)
    return a.select("symbol", "ann_return", "ann_vol", "sharpe", "max_drawdown", F.col("w.trading_date").alias("trough_date"), F.col("w.peak").alias("peak_date"))


@query(f"""WITH {VIX_SQL}, r AS (SELECT symbol, trading_date, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date)) AS x FROM vix), rv AS (
  SELECT *, count(x) OVER w AS n, stddev_samp(x) OVER w * sqrt(252) * 100 AS v FROM r WINDOW w AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT a.trading_date, a.close AS vix, b.close AS vvix, {sql_round('CASE WHEN a.n >= 16 THEN a.v END', 4)} AS realised, {sql_round('b.close / a.close', 4)} AS ratio,
  CASE WHEN b.close / a.close >= 7 THEN 'extreme' WHEN b.close / a.close >= 6 THEN 'escalated' WHEN b.close / a.close >= 5 THEN 'alert' ELSE 'normal' END AS zone,
  c.close / a.close >= 1 AS contango FROM rv a JOIN vix b ON b.trading_date = a.trading_date AND b.symbol = 'VVIX' JOIN vix c ON c.trading_date = a.trading_date AND c.symbol = 'VIX3M' WHERE a.symbol = 'VIX'""")
def vol_of_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility of the volatility index, its ratio's zone, and the curve's slope, by day."""
    v = vol_indices(spark, sf_dir)
    w = days().rowsBetween(-19, 0)
    a = v.where("symbol = 'VIX'").withColumn("x", F.log(F.col("close") / F.lag("close").over(days())))
    a = a.select("trading_date", F.col("close").alias("vix"), F.when(F.count("x").over(w) >= 16, F.stddev_samp("x").over(w) * math.sqrt(252) * 100).alias("rv"))
    side = lambda s, n: v.where(F.col("symbol") == s).select("trading_date", F.col("close").alias(n))
    j = a.join(side("VVIX", "vvix"), "trading_date").join(side("VIX3M", "vix3m"), "trading_date")
    ratio = F.col("vvix") / F.col("vix")
    return j.select("trading_date", "vix", "vvix", js_round(F.col("rv"), 4).alias("realised"), js_round(ratio, 4).alias("ratio"), F.when(ratio >= 7, "extreme").when(ratio >= 6, "escalated").when(ratio >= 5, "alert").otherwise("normal").alias("zone"), (F.col("vix3m") / F.col("vix") >= 1).alias("contango"))


@query(f"""WITH {VIX_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) AS r, close / first_value(close) OVER (PARTITION BY symbol ORDER BY trading_date) * 100 AS rebased FROM vix), y AS (SELECT * FROM l WHERE r <= 252)
SELECT symbol, trading_date, {sql_round('rebased', 6)} AS rebased, {sql_round('(rank() OVER (PARTITION BY symbol ORDER BY close) - 1 + 0.5e0 * count(*) OVER (PARTITION BY symbol, close)) / count(*) OVER (PARTITION BY symbol) * 100', 4)} AS mid_rank FROM y""")
def cross_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels rebased to 100 at the first day, and mid-ranks within the last year."""
    l = vol_indices(spark, sf_dir).withColumns({"r": F.row_number().over(latest()), "rebased": F.col("close") / F.first("close").over(symbol_days()) * 100}).where("r <= 252")  # noqa: E741
    return l.select("symbol", "trading_date", js_round(F.col("rebased"), 6).alias("rebased"), js_round(mid_rank("close", ["symbol"]), 4).alias("mid_rank"))


@query(f"""WITH {VIX_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) AS r FROM vix)
SELECT symbol, max(close) FILTER (r = 1) AS now, max(close) FILTER (r = 22) AS month_ago, {sql_round('median(close)', 4)} AS median_close FROM l GROUP BY 1""")
def vix_term_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index curve now, 21 days back, and its medians."""
    l = vol_indices(spark, sf_dir).withColumn("r", F.row_number().over(latest()))  # noqa: E741
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("close")))
    return l.groupBy("symbol").agg(at(1).alias("now"), at(22).alias("month_ago"), js_round(F.median("close"), 4).alias("median_close"))


@query(f"""WITH {PANEL_SQL}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date) AS q FROM panel)
SELECT symbol, trading_date, {sql_round("close * exp(coalesce(sum(CASE WHEN q < 0.65e0 OR q > 1.55e0 THEN ln(q) ELSE 0e0 END) OVER (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0e0))", 6)} AS adjusted_close FROM r""")
def split_adjusted_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes with earlier days rescaled at splits."""
    return split_adjusted(symbol_panel(spark, sf_dir), "symbol", "trading_date", "close").select("symbol", "trading_date", js_round(F.col("adjusted_close"), 6).alias("adjusted_close"))


BENCHMARK = "Brand#2"


def rotation_of(spark: SparkSession, sf_dir: str, smooth: int, slow: int, fast: int) -> DataFrame:
    p = split_adjusted(symbol_panel(spark, sf_dir), "symbol", "trading_date", "close").select("symbol", "trading_date", F.col("adjusted_close").alias("c"))
    bench = p.where(F.col("symbol") == BENCHMARK).select("trading_date", F.col("c").alias("b"))
    rs = p.where(F.col("symbol") != BENCHMARK).join(bench, "trading_date").where("b > 0").select("symbol", "trading_date", (F.col("c") / F.col("b") * 100).alias("rs"))
    return relative_rotation(rs, ["symbol"], "trading_date", "rs", smooth, slow, fast).where(F.col("n") >= smooth + slow + fast)


def quadrant(ratio, momentum):
    return F.when((ratio >= 100) & (momentum >= 100), "leading").when(ratio >= 100, "weakening").when(momentum >= 100, "improving").otherwise("lagging")


def ema_sql(source: str, value: str, window: int, out: str, extra: str = "") -> str:
    """Recursive common table expressions of an SMA-seeded EMA over ``source`` (symbol, i, trading_date, value)."""
    a = f"(2e0 / {window + 1})"
    return f"""{out}_v AS (SELECT symbol, i, {value} AS v, count({value}) OVER (PARTITION BY symbol ORDER BY i) AS k, avg({value}) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS m FROM {source} WHERE {value} IS NOT NULL),
{out} AS (SELECT symbol, i, m AS e FROM {out}_v WHERE k = {window} UNION ALL SELECT n.symbol, n.i, n.v * {a} + p.e * (1 - {a}) FROM {out} p JOIN {out}_v n ON n.symbol = p.symbol AND n.i = p.i + 1 AND n.k > {window})"""


@query(f"""WITH RECURSIVE {PANEL_SQL}, q AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date) AS q FROM panel),
adj AS (SELECT symbol, trading_date, close * exp(coalesce(sum(CASE WHEN q < 0.65e0 OR q > 1.55e0 THEN ln(q) ELSE 0e0 END) OVER (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0e0)) AS c FROM q),
rs AS (SELECT a.symbol, a.trading_date, a.c / b.c * 100 AS rs, row_number() OVER (PARTITION BY a.symbol ORDER BY a.trading_date) AS i FROM adj a JOIN adj b ON b.symbol = '{BENCHMARK}' AND b.trading_date = a.trading_date WHERE a.symbol <> '{BENCHMARK}'),
{ema_sql('rs', 'rs', 5, 'e1')}, s1 AS (SELECT symbol, i, e AS rs FROM e1), {ema_sql('s1', 'rs', 63, 'e2')}, s2 AS (SELECT a.symbol, a.i, a.rs / b.e * 100 AS ratio FROM s1 a JOIN e2 b USING (symbol, i)),
{ema_sql('s2', 'ratio', 13, 'e3')}, pts AS (SELECT s2.symbol, rs.trading_date, ratio, ratio / e * 100 AS momentum, row_number() OVER (PARTITION BY s2.symbol ORDER BY s2.i DESC) AS r FROM s2 JOIN e3 USING (symbol, i) JOIN rs USING (symbol, i))
SELECT symbol, trading_date, {sql_round('ratio', 5)} AS rs_ratio, {sql_round('momentum', 5)} AS rs_momentum,
  CASE WHEN ratio >= 100 AND momentum >= 100 THEN 'leading' WHEN ratio >= 100 THEN 'weakening' WHEN momentum >= 100 THEN 'improving' ELSE 'lagging' END AS quadrant FROM pts WHERE r <= 10""")
def relative_rotation_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten points of each symbol's relative rotation against the benchmark, and their quadrants."""
    r = rotation_of(spark, sf_dir, 5, 63, 13).withColumn("r", F.row_number().over(latest())).where("r <= 10")
    return r.select("symbol", "trading_date", js_round(F.col("rs_ratio"), 5).alias("rs_ratio"), js_round(F.col("rs_momentum"), 5).alias("rs_momentum"), quadrant(F.col("rs_ratio"), F.col("rs_momentum")).alias("quadrant"))


@query(f"""WITH {PANEL_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) AS r FROM panel), a AS (
  SELECT symbol, max(trading_date) FILTER (r = 1) AS as_of, max(close) FILTER (r = 1) AS c0, max(close) FILTER (r = 2) AS c1, max(close) FILTER (r = 6) AS c5, max(close) FILTER (r = 22) AS c21 FROM l GROUP BY 1)
SELECT symbol, as_of, {sql_round('(c0 / c1 - 1) * 100', 4)} AS change_1d, {sql_round('(c0 / c5 - 1) * 100', 4)} AS change_1w, {sql_round('(c0 / c21 - 1) * 100', 4)} AS change_1m,
  CASE WHEN (c0 / c1 - 1) * 100 > 0.1e0 THEN 'up' WHEN (c0 / c1 - 1) * 100 < -0.1e0 THEN 'down' ELSE 'flat' END AS breadth FROM a""")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes over one day, week and month, and the breadth class of the day."""
    l = symbol_panel(spark, sf_dir).withColumn("r", F.row_number().over(latest())).where("r <= 22")  # noqa: E741
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("close")))
    change = lambda k: (at(1) / at(k) - 1) * 100
    return l.groupBy("symbol").agg(F.max("trading_date").alias("as_of"), js_round(change(2), 4).alias("change_1d"), js_round(change(6), 4).alias("change_1w"), js_round(change(22), 4).alias("change_1m"), F.when(change(2) > 0.1, "up").when(change(2) < -0.1, "down").otherwise("flat").alias("breadth"))


@query(f"""WITH {PANEL_SQL}, d AS (SELECT trading_date, dense_rank() OVER (ORDER BY trading_date DESC) AS k FROM (SELECT DISTINCT trading_date FROM panel)), s AS (SELECT p.*, k FROM panel p JOIN d USING (trading_date) WHERE k <= 2),
c AS (SELECT symbol, max(close) FILTER (k = 1) AS now, max(close) FILTER (k = 2) AS before FROM s GROUP BY 1), m AS (SELECT symbol, (now / before - 1) * 100 AS pct FROM c WHERE now IS NOT NULL AND before IS NOT NULL)
SELECT symbol, {sql_round('pct', 4)} AS change_pct, row_number() OVER (ORDER BY pct DESC, symbol) AS rank_up, row_number() OVER (ORDER BY pct, symbol) AS rank_down FROM m""")
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change between the last two sessions of the market, for symbols that traded in both, with ranks."""
    p = symbol_panel(spark, sf_dir)
    sessions = p.select("trading_date").distinct().orderBy(F.desc("trading_date")).limit(2).withColumn("k", F.row_number().over(Window.orderBy(F.desc("trading_date"))))
    c = p.join(F.broadcast(sessions), "trading_date").groupBy("symbol").agg(*(F.max(F.when(F.col("k") == k, F.col("close"))).alias(n) for k, n in ((1, "now"), (2, "before"))))
    m = c.where("now is not null and before is not null").withColumn("pct", (F.col("now") / F.col("before") - 1) * 100)
    return m.select("symbol", js_round(F.col("pct"), 4).alias("change_pct"), F.row_number().over(Window.orderBy(F.desc("pct"), "symbol")).alias("rank_up"), F.row_number().over(Window.orderBy("pct", "symbol")).alias("rank_down"))


@query(f"""WITH {BARS30_SQL}, b AS (SELECT CAST(bucket AS DATE) AS trading_date, strftime(bucket, '%H:%M') AS bucket_time, close FROM bars30 WHERE strftime(bucket, '%H:%M') BETWEEN '09:30' AND '15:30'),
last AS (SELECT trading_date, max_by(close, bucket_time) AS day_close FROM b GROUP BY 1), prior AS (SELECT *, lag(day_close) OVER (ORDER BY trading_date) AS prior_close FROM last),
x AS (SELECT b.trading_date, bucket_time, (close / prior_close - 1) * 100 AS pct FROM b JOIN prior USING (trading_date) WHERE prior_close <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY bucket_time ORDER BY trading_date DESC) AS r FROM x)
SELECT trading_date, bucket_time, {sql_round('pct', 4)} AS pct, {sql_round('avg(CASE WHEN r <= 10 THEN pct END) OVER (PARTITION BY bucket_time)', 4)} AS mean_10d FROM k""")
def intraday_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour buckets against the prior session's close, with the mean of the last ten samples of a bucket."""
    b = half_hour_bars(spark, sf_dir).select(F.to_date("bucket").alias("trading_date"), F.date_format("bucket", "HH:mm").alias("bucket_time"), "close").where(F.col("bucket_time").between("09:30", "15:30"))
    prior = b.groupBy("trading_date").agg(F.max_by("close", "bucket_time").alias("c")).select("trading_date", F.lag("c").over(days()).alias("p"))
    x = b.join(prior, "trading_date").where("p <> 0").withColumn("pct", (F.col("close") / F.col("p") - 1) * 100)
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("bucket_time").orderBy(F.desc("trading_date"))))
    return x.select("trading_date", "bucket_time", js_round(F.col("pct"), 4).alias("pct"), js_round(F.avg(F.when(F.col("r") <= 10, F.col("pct"))).over(Window.partitionBy("bucket_time")), 4).alias("mean_10d"))


WEEKDAYS = ("mon", "tue", "wed", "thu", "fri")


@query(f"""WITH {BARS_SQL}, r AS (SELECT trading_date, (close / lag(close) OVER (ORDER BY trading_date) - 1) * 100 AS pct FROM bars), w AS (SELECT date_trunc('week', trading_date)::DATE AS week, isodow(trading_date) AS d, pct FROM r WHERE pct IS NOT NULL)
SELECT week, {', '.join(f"{sql_round(f'max(pct) FILTER (d = {i + 1})', 4)} AS {n}" for i, n in enumerate(WEEKDAYS))} FROM w GROUP BY 1""")
def daily_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns as a grid of week by weekday."""
    r = daily_bars(spark, sf_dir).select("trading_date", ((F.col("close") / F.lag("close").over(days()) - 1) * 100).alias("pct")).where("pct is not null")
    g = r.select(F.to_date(F.date_trunc("week", "trading_date")).alias("week"), F.lower(F.date_format("trading_date", "E")).alias("d"), "pct").groupBy("week").pivot("d", list(WEEKDAYS)).agg(F.max("pct"))
    return g.select("week", *(js_round(F.col(n), 4).alias(n) for n in WEEKDAYS))


@query(f"""WITH {BARS_SQL}, w AS (SELECT isoyear(trading_date) AS iso_year, week(trading_date) AS iso_week, max_by(close, trading_date) AS close, max(trading_date) AS last FROM bars GROUP BY 1, 2),
r AS (SELECT iso_year, iso_week, (close / lag(close) OVER (ORDER BY last) - 1) * 100 AS pct FROM w)
SELECT CAST(iso_year AS INTEGER) AS iso_year, CAST(iso_week AS INTEGER) AS iso_week, {sql_round('pct', 4)} AS pct, {sql_round('avg(pct) OVER (PARTITION BY iso_week)', 4)} AS mean_all_years FROM r WHERE pct IS NOT NULL""")
def weekly_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly returns by ISO year and week with the mean over all years."""
    w = daily_bars(spark, sf_dir).groupBy(F.extract(F.lit("yearofweek"), "trading_date").cast("int").alias("iso_year"), F.weekofyear("trading_date").alias("iso_week")).agg(F.max_by("close", "trading_date").alias("close"), F.max("trading_date").alias("last"))
    r = w.withColumn("pct", (F.col("close") / F.lag("close").over(Window.orderBy("last")) - 1) * 100).where("pct is not null")
    return r.select("iso_year", "iso_week", js_round(F.col("pct"), 4).alias("pct"), js_round(F.avg("pct").over(Window.partitionBy("iso_week")), 4).alias("mean_all_years"))


OSC_SQL = f"{VIX_SQL}, osc AS (SELECT trading_date, (close - 22) / 1e0 AS v FROM vix WHERE symbol = 'VIX')"


@query(f"""WITH {OSC_SQL}, s AS (SELECT count(*) AS n, greatest(1.06e0 * stddev_samp(v) * pow(count(*), -0.2e0), 0.15e0) AS h FROM osc), grid AS (SELECT unnest(generate_series(-40, 40)) / 4e0 AS y),
k AS (SELECT y, sum(exp(-((y - v) * (y - v)) / (2 * h * h))) / (max(n) * max(h) * sqrt(2 * pi())) AS density FROM grid, osc, s GROUP BY y)
SELECT y, {sql_round('density / max(density) OVER ()', 6)} AS density FROM k""")
def oscillator_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian density of an oscillator on 81 grid points, as a share of its peak.

    Each value explodes to the grid and sums are pre-aggregated per task.
    """
    v = vol_indices(spark, sf_dir).where("symbol = 'VIX'").select((F.col("close") - 22).alias("v"))
    s = v.agg(F.count("*").alias("n"), F.greatest(F.lit(1.06) * F.stddev_samp("v") * F.pow(F.count("*").cast("double"), F.lit(-0.2)), F.lit(0.15)).alias("h")).first()
    n, h = s["n"], s["h"] or 1.0
    d = F.col("y") - F.col("v")
    k = v.withColumn("y", F.explode(F.transform(F.sequence(F.lit(-40), F.lit(40)), lambda i: i / F.lit(4.0)))).groupBy("y").agg((F.sum(F.exp(-(d * d) / F.lit(2 * h * h))) / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))
    return k.select("y", js_round(F.col("density") / F.max("density").over(Window.partitionBy(F.lit(0))), 6).alias("density"))


@query(f"""WITH {OSC_SQL}, r AS (SELECT *, lag(v) OVER (ORDER BY trading_date) AS v0, lag(trading_date) OVER (ORDER BY trading_date) AS t0, CASE WHEN sign(v) <> coalesce(lag(sign(v)) OVER (ORDER BY trading_date), 9) THEN 1 ELSE 0 END AS new FROM osc),
i AS (SELECT *, sum(new) OVER (ORDER BY trading_date) AS run_id FROM r)
SELECT CAST(run_id AS BIGINT) AS run_id, min(trading_date) AS first_date, max(trading_date) AS last_date, count(*) AS days, CAST(max(sign(v)) AS INTEGER) AS side,
  {sql_round("max(CASE WHEN new = 1 THEN datediff('day', DATE '1970-01-01', t0) - v0 / (v - v0) * datediff('day', t0, trading_date) END)", 4)} AS crossing_day FROM i GROUP BY run_id""")
def oscillator_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one sign with the interpolated day on which each began."""
    v = vol_indices(spark, sf_dir).where("symbol = 'VIX'").select("trading_date", (F.col("close") - 22).alias("v"), F.lit(0).alias("k"))
    w = Window.partitionBy("k").orderBy("trading_date")
    x = runs(v.withColumns({"v0": F.lag("v").over(w), "t0": F.lag("trading_date").over(w)}), ["k"], "trading_date", F.signum("v"))
    began = F.when(F.signum("v") != F.signum("v0"), F.unix_date("t0") - F.col("v0") / (F.col("v") - F.col("v0")) * F.datediff("trading_date", "t0"))
    return x.groupBy("run_id").agg(F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count("*").alias("days"), F.max(F.signum("v")).cast("int").alias("side"), js_round(F.max(began), 4).alias("crossing_day"))


@query(f"""WITH {OSC_SQL}, r AS (SELECT *, lag(v) OVER (ORDER BY trading_date) AS v0, lag(trading_date) OVER (ORDER BY trading_date) AS t0 FROM osc)
SELECT CAST(datediff('day', DATE '1970-01-01', trading_date) AS DOUBLE) AS at_day, {sql_round('v', 4)} AS v, 'point' AS kind FROM r
UNION ALL SELECT {sql_round("datediff('day', DATE '1970-01-01', t0) - v0 / (v - v0) * datediff('day', t0, trading_date)", 4)}, 0e0, 'crossing' FROM r WHERE v0 * v < 0""")
def oscillator_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oscillator's points and, between two of unlike sign, the interpolated point where it is zero."""
    v = vol_indices(spark, sf_dir).where("symbol = 'VIX'").select("trading_date", (F.col("close") - 22).alias("v"))
    r = v.withColumns({"v0": F.lag("v").over(days()), "t0": F.lag("trading_date").over(days())})
    zero = F.unix_date("t0") - F.col("v0") / (F.col("v") - F.col("v0")) * F.datediff("trading_date", "t0")
    points = r.select(F.unix_date("trading_date").cast("double").alias("at_day"), js_round(F.col("v"), 4).alias("v"), F.lit("point").alias("kind"))
    return points.unionAll(r.where(F.col("v0") * F.col("v") < 0).select(js_round(zero, 4), F.lit(0.0), F.lit("crossing")))


@query(f"""WITH {VIX_SQL}, p AS (SELECT a.close AS x, b.close AS y FROM vix a JOIN vix b USING (trading_date) WHERE a.symbol = 'VIX' AND b.symbol = 'VVIX' AND b.close > 0)
SELECT count(*) AS n, {sql_round('exp(regr_intercept(ln(y), x))', 6)} AS a, {sql_round('regr_slope(ln(y), x)', 6)} AS b, {sql_round('regr_r2(ln(y), x)', 6)} AS r2 FROM p HAVING count(*) >= 10""")
def exponential_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y = a exp(b x) between two indices by least squares on the logarithm."""
    v = vol_indices(spark, sf_dir)
    p = v.where("symbol = 'VIX'").select("trading_date", F.col("close").alias("x")).join(v.where("symbol = 'VVIX' and close > 0").select("trading_date", F.log("close").alias("y")), "trading_date")
    return p.agg(F.count("*").alias("n"), js_round(F.exp(F.regr_intercept("y", "x")), 6).alias("a"), js_round(F.regr_slope("y", "x"), 6).alias("b"), js_round(F.regr_r2("y", "x"), 6).alias("r2")).where("n >= 10")
