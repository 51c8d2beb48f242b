"""Volatility pages: the index curve's state, series payloads, projections, densities, other forms of a smile, tiles with their fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.numeric import js_round, norm_cdf
from vegaflow.plans import daily
from vegaflow.plans.daily import latest, symbol_days
from vegaflow.plans.modelled import SURFACE_SQL, surface_df
from vegaflow.plans.registry import SQL, query
from vegaflow.sources.fixtures import BARS_SQL, MACRO_SQL, PANEL_SQL, VIX_SQL, contracts, daily_bars, macro_events, sql_cdf, sql_round, symbol_panel, vol_indices

#: The curve from front to long; symbols without a series have a gap there.
CURVE = ("VIX1D", "VIX9D", "VIX", "VIX3M", "VIX6M", "VIX1Y")
#: The zones of volatility of volatility over volatility, highest first.
ZONES = ((7.0, "extreme"), (6.0, "escalated"), (5.0, "alert"))


@query(f"""WITH {VIX_SQL}, l AS (SELECT symbol, max_by(close, trading_date) AS close, max(trading_date) AS day FROM vix GROUP BY 1), p AS (SELECT {', '.join(f"max(close) FILTER (symbol = '{s}') AS {s.lower()}" for s in (*CURVE, 'VVIX'))}, max(day) AS as_of FROM l)
SELECT as_of, {', '.join(s.lower() for s in (*CURVE, 'VVIX'))}, {sql_round('vix3m / vix', 4)} AS vix3m_vix_ratio, CASE WHEN vix3m >= vix THEN 'contango' WHEN vix3m < vix THEN 'backwardation' END AS term_regime, {sql_round('vvix / vix', 4)} AS vvix_vix_ratio,
  CASE {' '.join(f"WHEN vvix / vix >= {x!r}::DOUBLE THEN '{z}'" for x, z in ZONES)} WHEN vvix IS NOT NULL THEN 'normal' END AS vvix_vix_zone FROM p""")
def vix_curve_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest level along the curve, its regime from the front to three months, and the zone of volatility of volatility; one row."""
    last = vol_indices(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "trading_date").alias("close"), F.max("trading_date").alias("day"))
    p = last.agg(*(F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(s.lower()) for s in (*CURVE, "VVIX")), F.max("day").alias("as_of"))
    ratio, slope = F.col("vvix") / F.col("vix"), F.col("vix3m") >= F.col("vix")
    zone = F.when(ratio >= ZONES[0][0], ZONES[0][1])
    for least, name in ZONES[1:]:
        zone = zone.when(ratio >= least, name)
    return p.select("as_of", *(s.lower() for s in (*CURVE, "VVIX")), js_round(F.col("vix3m") / F.col("vix"), 4).alias("vix3m_vix_ratio"), F.when(slope, "contango").when(~slope, "backwardation").alias("term_regime"), js_round(ratio, 4).alias("vvix_vix_ratio"), zone.when(F.col("vvix").isNotNull(), "normal").alias("vvix_vix_zone"))


@query(f"""WITH {VIX_SQL}, stats AS ({SQL['vol_stats']}), {BARS_SQL}, spx AS (SELECT trading_date, close AS spx_close, hv_20d_yz, iv_30d_cm FROM stats JOIN bars USING (trading_date)), rows_of AS (SELECT symbol, trading_date, close, CAST(round(close * 100) AS BIGINT) AS x, NULL::BIGINT AS hv, NULL::BIGINT AS iv FROM vix
UNION ALL SELECT 'SPX', trading_date, spx_close, CAST(round(spx_close * 100) AS BIGINT), CAST(floor(hv_20d_yz * 1e5 + 0.5e0) AS BIGINT), CAST(floor(iv_30d_cm * 1e5 + 0.5e0) AS BIGINT) FROM spx WHERE hv_20d_yz IS NOT NULL OR iv_30d_cm IS NOT NULL)
SELECT symbol, count(*) AS n, max(trading_date) AS latest_date, max_by(close, trading_date) AS latest_close, string_agg(strftime(trading_date, '%Y-%m-%d') || ':' || x || coalesce(':' || hv, '') || coalesce(':' || iv, ''), ',' ORDER BY trading_date) AS series FROM rows_of GROUP BY 1""")
def vix_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every index's series as the page is sent it: day and close in hundredths; for the underlying also realised and implied volatility in hundred-thousandths, warm-up days left out."""
    none = F.lit(None).cast("long")
    v = vol_indices(spark, sf_dir).select("symbol", "trading_date", "close", none.alias("hv"), none.alias("iv"))
    s = daily.vol_stats(spark, sf_dir).where("hv_20d_yz is not null or iv_30d_cm is not null").join(daily_bars(spark, sf_dir).select("trading_date", "close"), "trading_date")
    scaled = lambda c: F.floor(F.col(c) * 1e5 + 0.5).cast("long")
    s = s.select(F.lit("SPX").alias("symbol"), "trading_date", "close", scaled("hv_20d_yz").alias("hv"), scaled("iv_30d_cm").alias("iv"))
    point = F.concat_ws(":", F.col("trading_date").cast("string"), F.round(F.col("close") * 100).cast("long").cast("string"), F.col("hv").cast("string"), F.col("iv").cast("string"))
    g = v.unionByName(s).groupBy("symbol").agg(F.count("*").alias("n"), F.max("trading_date").alias("latest_date"), F.max_by("close", "trading_date").alias("latest_close"), F.array_sort(F.collect_list(F.struct("trading_date", point.alias("p")))).alias("r"))
    return g.select("symbol", "n", "latest_date", "latest_close", F.array_join(F.col("r.p"), ",").alias("series"))


#: Trading days ahead.
HORIZONS = (1, 5, 10, 21, 42, 63, 126, 252)


@query(f"""WITH {VIX_SQL}, x AS (SELECT symbol, close, trading_date, ln(close) AS x, lead(ln(close)) OVER (PARTITION BY symbol ORDER BY trading_date) AS y FROM vix WHERE close > 0),
f AS (SELECT symbol, max_by(close, trading_date) AS last, count(y) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt(regr_syy(y, x) / regr_count(y, x) * (1 - regr_r2(y, x))) AS sd FROM x GROUP BY 1)
SELECT symbol, h AS days_ahead, {sql_round('exp(a / (1 - b) + (ln(last) - a / (1 - b)) * pow(b, h))', 4)} AS expected_level, {sql_round('sd * sqrt((1 - pow(b, 2 * h)) / (1 - b * b))', 6)} AS log_sd FROM f, (SELECT unnest({list(HORIZONS)}) AS h) WHERE n >= 59 AND b > 0 AND b < 1""")
def ou_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where mean reversion takes each index over the horizons, and how wide the log level spreads by then."""
    x = vol_indices(spark, sf_dir).where("close > 0").select("symbol", "trading_date", "close", F.log("close").alias("x"), F.lead(F.log("close")).over(symbol_days()).alias("y"))
    f = x.groupBy("symbol").agg(F.max_by("close", "trading_date").alias("last"), F.count("y").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.sqrt(F.regr_syy("y", "x") / F.regr_count("y", "x") * (1 - F.regr_r2("y", "x"))).alias("sd"))
    f = f.where("n >= 59 and b > 0 and b < 1").withColumn("h", F.explode(F.array(*map(F.lit, HORIZONS))))
    b, theta = F.col("b"), F.col("a") / (1 - F.col("b"))
    return f.select("symbol", F.col("h").alias("days_ahead"), js_round(F.exp(theta + (F.log("last") - theta) * F.pow(b, F.col("h"))), 4).alias("expected_level"), js_round(F.col("sd") * F.sqrt((1 - F.pow(b, 2 * F.col("h"))) / (1 - b * b)), 6).alias("log_sd"))


#: Hours up to which an event has a tier, and beyond.
TIERS, BEYOND = ((0, "past"), (1, "now"), (6, "soon"), (24, "today"), (72, "week")), "far"


@query(f"""WITH {MACRO_SQL}, told AS (SELECT min(event_id) AS event_id, title, ts FROM macro GROUP BY title, ts), now AS (SELECT min(ts) + INTERVAL 10 DAY AS at_time FROM macro)
SELECT event_id, title, CAST(floor((epoch_us(ts) - epoch_us(at_time)) / 6e7) AS BIGINT) AS minutes_ahead, CASE {' '.join(f"WHEN epoch_us(ts) - epoch_us(at_time) <= {h * 3600000000} THEN '{t}'" for h, t in TIERS)} ELSE '{BEYOND}' END AS urgency FROM told, now""")
def event_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each announcement is, seen from ten days behind the first."""
    e = macro_events(spark, sf_dir)
    now = e.agg((F.min("ts") + F.expr("interval 10 days")).alias("now"))
    x = e.groupBy("title", "ts").agg(F.min("event_id").alias("event_id")).join(F.broadcast(now)).withColumn("ahead", F.unix_micros("ts") - F.unix_micros("now"))
    tier: Column | None = None
    for hours, name in TIERS:
        hit = F.col("ahead") <= hours * 3_600_000_000
        tier = F.when(hit, name) if tier is None else tier.when(hit, name)
    return x.select("event_id", "title", F.floor(F.col("ahead") / F.lit(6e7)).alias("minutes_ahead"), tier.otherwise(BEYOND).alias("urgency"))


@query(f"""WITH {SURFACE_SQL}, n AS (SELECT *, sqrt(1 - rho * rho) / s AS zeta FROM surface)
SELECT run_id, dte, {sql_round('a - b / zeta * (1 - rho * rho)', 8)} AS delta, {sql_round('m + rho / zeta', 8)} AS mu, {sql_round('rho', 8)} AS rho, {sql_round('2 * b / zeta', 8)} AS omega, {sql_round('zeta', 8)} AS zeta FROM n""")
def svi_natural_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The natural form of every slice's closed-form smile: delta + omega / 2 (1 + zeta rho (k - mu) + sqrt((zeta (k - mu) + rho)^2 + 1 - rho^2))."""
    rho, b = F.col("rho"), F.col("b")
    x = surface_df(spark, sf_dir).withColumn("zeta", F.sqrt(1 - rho * rho) / F.col("s"))
    z = F.col("zeta")
    out = {"delta": F.col("a") - b / z * (1 - rho * rho), "mu": F.col("m") + rho / z, "rho": rho, "omega": b * 2 / z, "zeta": z}
    return x.select("run_id", "dte", *(js_round(c, 8).alias(n) for n, c in out.items()))


#: Nodes of a density on either side of the spot, and nodes to a unit of log-moneyness.
SIDE, FINE = 200, 1000 / 3


@query(f"""WITH {SURFACE_SQL}, g AS (SELECT run_id, dte, dte / 365e0 AS t, i, i / {FINE!r}::DOUBLE AS k, a + b * (rho * (i / {FINE!r}::DOUBLE - m) + sqrt(pow(i / {FINE!r}::DOUBLE - m, 2) + s * s)) AS w, a + b * (-rho * m + sqrt(m * m + s * s)) AS w0 FROM surface, (SELECT unnest(generate_series(-{SIDE}, {SIDE})) AS i)),
c AS (SELECT *, exp(k) AS x, {sql_cdf('(-k / sqrt(w) + sqrt(w) / 2)')} - exp(k) * {sql_cdf('(-k / sqrt(w) - sqrt(w) / 2)')} AS call FROM g),
n AS (SELECT *, lag(x) OVER o AS x0, lead(x) OVER o AS x1, lag(call) OVER o AS c0, lead(call) OVER o AS c1 FROM c WINDOW o AS (PARTITION BY run_id, dte ORDER BY i)),
d AS (SELECT *, coalesce(greatest(2 * ((x - x0) * c1 - (x1 - x0) * call + (x1 - x) * c0) / ((x - x0) * (x1 - x) * (x1 - x0)), 0), 0) AS f FROM n),
z AS (SELECT *, sum(0.5e0 * (f + before) * (x - x0)) OVER (PARTITION BY run_id, dte) AS area FROM (SELECT *, lag(f) OVER (PARTITION BY run_id, dte ORDER BY i) AS before FROM d))
SELECT run_id, dte, {sql_round('k', 6)} AS k, {sql_round('CASE WHEN area > 0 THEN f / area ELSE f END', 5)} AS density, {sql_round('exp(-0.5e0 * pow((k + 0.5e0 * w0) / sqrt(w0), 2)) / (x * sqrt(w0) * sqrt(2 * pi()))', 5)} AS lognormal FROM z""")
def density_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk-neutral density of every slice along the strikes (per unit of spot) and the lognormal one of equal variance at the money.

    Second differences of calls on an uneven grid, what is under zero cut off, and
    the rest normalised; a slice's nodes are one window.
    """
    k, m, s, rho = (F.col(c) for c in ("k", "m", "s", "rho"))
    w = lambda k: F.col("a") + F.col("b") * (rho * (k - m) + F.sqrt((k - m) * (k - m) + s * s))
    x = surface_df(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(-SIDE), F.lit(SIDE)))).withColumn("k", F.col("i") / F.lit(FINE)).withColumns({"w": w(k), "w0": w(F.lit(0.0)), "x": F.exp("k")})
    root = F.sqrt("w")
    x = x.withColumn("call", norm_cdf(-k / root + root / 2) - F.col("x") * norm_cdf(-k / root - root / 2))
    o, whole = Window.partitionBy("run_id", "dte").orderBy("i"), Window.partitionBy("run_id", "dte")
    x = x.withColumns({"x0": F.lag("x").over(o), "x1": F.lead("x").over(o), "c0": F.lag("call").over(o), "c1": F.lead("call").over(o)})
    left, right = F.col("x") - F.col("x0"), F.col("x1") - F.col("x")
    second = 2 * (left * F.col("c1") - (left + right) * F.col("call") + right * F.col("c0")) / (left * right * (left + right))
    x = x.withColumn("f", F.coalesce(F.when(second > 0, second).otherwise(F.lit(0.0)), F.lit(0.0)))
    x = x.withColumn("strip", F.lit(0.5) * (F.col("f") + F.lag("f").over(o)) * left).withColumn("area", F.sum("strip").over(whole))
    flat = F.exp(F.lit(-0.5) * F.pow((k + F.lit(0.5) * F.col("w0")) / F.sqrt("w0"), F.lit(2.0))) / (F.col("x") * F.sqrt("w0") * F.lit((2 * 3.141592653589793) ** 0.5))
    return x.select("run_id", "dte", js_round(k, 6).alias("k"), js_round(F.when(F.col("area") > 0, F.col("f") / F.col("area")).otherwise(F.col("f")), 5).alias("density"), js_round(flat, 5).alias("lognormal"))


#: Funds that stand in for their sectors.
FUNDS = {f"Brand#{n}": sector for n, sector in enumerate(("Energy", "Materials", "Industrials", "Discretionary", "Staples", "Health", "Financials", "Technology", "Communication", "Utilities", "Real Estate"), 11)}


def tiles(prices: DataFrame, stored: DataFrame) -> DataFrame:
    """mode, symbol, name, last, prev, change_pct, as_of: a tile for each symbol of the feed's last two sessions; of the funds' stored closes where the feed gave nothing.

    ``prices`` and ``stored`` have symbol, trading_date, close. A symbol that the
    last session lacks has a tile without a change; a fund needs two closes.
    """
    sessions = prices.select("trading_date").distinct().orderBy(F.desc("trading_date")).limit(2).withColumn("k", F.row_number().over(Window.orderBy(F.desc("trading_date"))))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("close")))
    live = prices.join(F.broadcast(sessions), "trading_date").groupBy("symbol").agg(at(1).alias("last"), at(2).alias("prev"))
    day = sessions.where("k = 1").select(F.col("trading_date").alias("as_of"))
    live = live.join(F.broadcast(day)).select(F.lit("constituents").alias("mode"), "symbol", F.col("symbol").alias("name"), "last", "prev", "as_of")
    names = F.create_map(*(F.lit(x) for kv in FUNDS.items() for x in kv))
    two = stored.where(F.col("symbol").isin(*FUNDS)).withColumn("k", F.row_number().over(latest())).where("k <= 2")
    funds = two.groupBy("symbol").agg(at(1).alias("last"), at(2).alias("prev"), F.max("trading_date").alias("day"), F.count("*").alias("n")).where("n = 2 and prev > 0")
    funds = funds.select(F.lit("sector-fund-fallback").alias("mode"), "symbol", names[F.col("symbol")].alias("name"), "last", "prev", F.max("day").over(Window.partitionBy(F.lit(0))).alias("as_of"))
    fed = live.agg((F.count("*") > 0).alias("fed"))
    out = live.unionByName(funds.join(F.broadcast(fed)).where("not fed").drop("fed"))
    change = F.when((F.col("prev") > 0) & F.col("last").isNotNull(), (F.col("last") - F.col("prev")) / F.col("prev") * 100)
    return out.select("mode", "symbol", "name", js_round(F.col("last"), 4).alias("last"), js_round(F.col("prev"), 4).alias("prev"), js_round(change, 4).alias("change_pct"), "as_of")


@query(f"""WITH {PANEL_SQL}, d AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date DESC) AS k FROM (SELECT DISTINCT trading_date FROM panel)), names(symbol, name) AS (VALUES {', '.join(f"('{s}', '{n}')" for s, n in FUNDS.items())}),
live AS (SELECT 'live' AS feed, 'constituents' AS mode, symbol, symbol AS name, max(close) FILTER (k = 1) AS last, max(close) FILTER (k = 2) AS prev, (SELECT trading_date FROM d WHERE k = 1) AS as_of FROM panel JOIN d USING (trading_date) WHERE k <= 2 GROUP BY symbol),
two AS (SELECT symbol, name, close, trading_date, row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) AS k FROM panel JOIN names USING (symbol)),
funds AS (SELECT 'down' AS feed, 'sector-fund-fallback' AS mode, symbol, any_value(name) AS name, max(close) FILTER (k = 1) AS last, max(close) FILTER (k = 2) AS prev, (SELECT max(trading_date) FROM two) AS as_of FROM two WHERE k <= 2 GROUP BY symbol HAVING count(*) = 2)
SELECT feed, mode, symbol, name, {sql_round('last', 4)} AS last, {sql_round('prev', 4)} AS prev, {sql_round('(last - prev) / prev * 100', 4)} AS change_pct, as_of FROM (SELECT * FROM live UNION ALL SELECT * FROM funds)""")
def heatmap_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heatmap as it is with its feed, and as it falls back to sector funds when the feed is down."""
    p = symbol_panel(spark, sf_dir)
    up = tiles(p, p).withColumn("feed", F.lit("live"))
    return up.unionByName(tiles(p.where("false"), p).withColumn("feed", F.lit("down")))



#: The grid of a run's surface: fortieths of log-moneyness up to EDGE / 40 either side, by listed expirations; and the days that it is looked up at.
EDGE, TENORS = 16, (10, 30, 45, 60, 90, 120, 200)


@query(f"""WITH {SURFACE_SQL}, grid AS (SELECT run_id, dte, i, sqrt((a + b * (rho * (i / 4e1 - m) + sqrt(pow(i / 4e1 - m, 2) + s * s))) / (dte / 365e0)) AS iv FROM surface, (SELECT unnest(generate_series(-{EDGE}, {EDGE})) AS i)),
asked AS (SELECT DISTINCT run_id, strike, tenor, greatest(-{EDGE / 40!r}::DOUBLE, least({EDGE / 40!r}::DOUBLE, ln(strike / spot))) * 40 AS y FROM contracts, (SELECT unnest({list(TENORS)}) AS tenor)),
ends AS (SELECT a.*, least({EDGE - 1}, CAST(floor(y) AS INTEGER)) AS i, coalesce(max(l.dte) FILTER (l.dte <= tenor), min(l.dte)) AS t0, coalesce(min(l.dte) FILTER (l.dte >= tenor), max(l.dte)) AS t1 FROM asked a JOIN (SELECT DISTINCT run_id, dte FROM surface) l USING (run_id) GROUP BY ALL)
SELECT e.run_id, e.strike, e.tenor, {sql_round('(CASE WHEN t1 > t0 THEN (t1 - tenor) / CAST(t1 - t0 AS DOUBLE) ELSE 1e0 END) * (g00.iv * (1 - (y - e.i)) + g01.iv * (y - e.i)) + (CASE WHEN t1 > t0 THEN (tenor - t0) / CAST(t1 - t0 AS DOUBLE) ELSE 0e0 END) * (g10.iv * (1 - (y - e.i)) + g11.iv * (y - e.i))', 8)} AS iv
FROM ends e JOIN grid g00 ON g00.run_id = e.run_id AND g00.dte = t0 AND g00.i = e.i JOIN grid g01 ON g01.run_id = e.run_id AND g01.dte = t0 AND g01.i = e.i + 1 JOIN grid g10 ON g10.run_id = e.run_id AND g10.dte = t1 AND g10.i = e.i JOIN grid g11 ON g11.run_id = e.run_id AND g11.dte = t1 AND g11.i = e.i + 1""")
def surface_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility of every listed strike at fixed tenors, between the four nodes around it on its run's grid; held at the grid's edges.

    A run's grid is one row of arrays (as many as it has expirations), so a strike
    finds its nodes in its own row after one join by run.
    """
    k, m, s = F.col("k"), F.col("m"), F.col("s")
    w = F.col("a") + F.col("b") * (F.col("rho") * (k - m) + F.sqrt((k - m) * (k - m) + s * s))
    nodes = surface_df(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(-EDGE), F.lit(EDGE)))).withColumn("k", F.col("i") / F.lit(40.0))
    rows = nodes.select("run_id", "dte", "i", F.sqrt(w / (F.col("dte") / F.lit(365.0))).alias("iv")).groupBy("run_id", "dte").agg(F.array_sort(F.collect_list(F.struct("i", "iv")))["iv"].alias("ivs"))
    grids = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("dte", "ivs"))).alias("grid"))
    asked = contracts(spark, sf_dir).select("run_id", "spot", "strike").distinct().withColumn("tenor", F.explode(F.array(*map(F.lit, TENORS))))
    edge = F.lit(EDGE / 40)
    x = asked.withColumn("y", F.greatest(-edge, F.least(edge, F.log(F.col("strike") / F.col("spot")))) * 40).withColumn("i", F.least(F.lit(EDGE - 1), F.floor("y").cast("int"))).join(grids, "run_id")
    below, above = F.filter("grid", lambda g: g["dte"] <= F.col("tenor")), F.filter("grid", lambda g: g["dte"] >= F.col("tenor"))
    x = x.withColumns({"lo": F.coalesce(F.try_element_at(below, F.lit(-1)), F.element_at("grid", 1)), "hi": F.coalesce(F.try_element_at(above, F.lit(1)), F.element_at("grid", -1))})
    share, at = F.col("y") - F.col("i"), F.col("i") + EDGE
    level = lambda side: F.col(f"{side}.ivs")[at] * (1 - share) + F.col(f"{side}.ivs")[at + 1] * share
    gap, into = F.col("hi.dte") - F.col("lo.dte"), F.col("tenor") - F.col("lo.dte")
    iv = F.when(gap > 0, (gap - into) / gap * level("lo") + into / gap * level("hi")).otherwise(level("lo"))
    return x.select("run_id", "strike", "tenor", js_round(iv, 8).alias("iv"))
