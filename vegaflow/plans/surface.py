"""Queries across strikes and expirations: fixed-strike volatility, skew, implied moves and rates, probes, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.numeric import bs_price, js_round
from vegaflow.operators.series import as_of
from vegaflow.plans.chain import METRICS_SQL, STRIKES_SQL, WALLS_SQL, by_strike, expiration_metrics_of, wall_levels
from vegaflow.plans.registry import query
from vegaflow.sources.fixtures import CONTRACTS_SQL, contracts, events, sql_cdf, sql_round

#: Strike steps that a ladder may have.
STEPS = (1, 2.5, 5, 10, 25, 50, 100)
ROWS = 21


def ladder(c: DataFrame) -> DataFrame:
    """run_id, spot, target: 21 strikes around spot, a round step nearest 1 % of it apart."""
    step = F.array_min(F.array(*(F.struct(F.abs(F.lit(float(s)) - F.col("spot") * 0.01).alias("d"), F.lit(float(s)).alias("s")) for s in STEPS)))["s"]
    runs = c.select("run_id", "spot").distinct().withColumn("step", step)
    return runs.withColumn("k", F.explode(F.sequence(F.lit(-(ROWS // 2)), F.lit(ROWS // 2)))).select("run_id", "spot", (js_round(F.col("spot") / F.col("step")) * F.col("step") + F.col("k") * F.col("step")).alias("target"))


@query(f"""WITH {CONTRACTS_SQL}, steps AS (SELECT unnest([1e0, 2.5e0, 5e0, 1e1, 25e0, 5e1, 1e2]) AS s), runs AS (SELECT DISTINCT run_id, spot FROM contracts),
st AS (SELECT run_id, spot, min_by(s, abs(s - spot * 0.01e0) * 1e6 + s) AS step FROM runs, steps GROUP BY ALL),
lad AS (SELECT run_id, spot, floor(spot / step + 0.5e0) * step + k * step AS target FROM st, (SELECT unnest(generate_series(-10, 10)) AS k)),
exps AS (SELECT run_id, dte FROM (SELECT DISTINCT run_id, dte FROM contracts) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY dte) > 1),
cell AS (SELECT l.run_id, e.dte, l.target, l.spot,
    max(c.strike) FILTER (c.strike <= target AND c.is_call = (target > l.spot)) AS k0, max_by(c.iv, c.strike) FILTER (c.strike <= target AND c.is_call = (target > l.spot)) AS v0,
    min(c.strike) FILTER (c.strike >= target AND c.is_call = (target > l.spot)) AS k1, min_by(c.iv, c.strike) FILTER (c.strike >= target AND c.is_call = (target > l.spot)) AS v1
  FROM lad l JOIN exps e USING (run_id) JOIN contracts c ON c.run_id = l.run_id AND c.dte = e.dte GROUP BY ALL),
m AS (SELECT run_id, dte, target, CASE WHEN k0 = k1 THEN v1 WHEN k0 IS NOT NULL AND k1 IS NOT NULL THEN v0 * (1 - (target - k0) / (k1 - k0)) + v1 * ((target - k0) / (k1 - k0)) ELSE coalesce(v1, v0) END AS iv FROM cell)
SELECT run_id, dte, target AS strike, {sql_round('iv * 100', 4)} AS iv_pct, {sql_round('(iv - lag(iv) OVER (PARTITION BY dte, target ORDER BY run_id)) * 100', 4)} AS change_pct FROM m""")
def fixed_strike_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-the-money volatility on a ladder of strikes by expiration, and its change from the previous run that has the cell.

    Strikes of a side are gathered per (run, expiration), as many as are listed,
    and interpolated; the ladder joins those few rows, not the contracts.
    """
    c = contracts(spark, sf_dir)
    sides = c.groupBy("run_id", "dte").agg(*(F.array_sort(F.collect_list(F.when(F.col("is_call") == call, F.struct("strike", "iv")))).alias(n) for n, call in (("calls", True), ("puts", False))))
    sides = sides.withColumn("e", F.row_number().over(Window.partitionBy("run_id").orderBy("dte"))).where("e > 1")
    j = sides.join(ladder(c), "run_id").withColumn("side", F.when(F.col("target") > F.col("spot"), F.col("calls")).otherwise(F.col("puts")))
    lo, hi = F.element_at(F.filter("side", lambda x: x["strike"] <= F.col("target")), -1), F.filter("side", lambda x: x["strike"] >= F.col("target"))
    j = j.withColumns({"lo": F.when(F.size(F.filter("side", lambda x: x["strike"] <= F.col("target"))) > 0, lo), "hi": F.when(F.size(hi) > 0, F.element_at(hi, 1))})
    w = (F.col("target") - F.col("lo.strike")) / (F.col("hi.strike") - F.col("lo.strike"))
    iv = F.when(F.col("lo.strike") == F.col("hi.strike"), F.col("hi.iv")).when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.col("lo.iv") * (1 - w) + F.col("hi.iv") * w).otherwise(F.coalesce("hi.iv", "lo.iv"))
    m = j.select("run_id", "dte", F.col("target").alias("strike"), iv.alias("iv"))
    before = F.lag("iv").over(Window.partitionBy("dte", "strike").orderBy("run_id"))
    return m.select("run_id", "dte", "strike", js_round(F.col("iv") * 100, 4).alias("iv_pct"), js_round((F.col("iv") - before) * 100, 4).alias("change_pct"))


@query(f"""WITH {CONTRACTS_SQL}, e AS (SELECT run_id, dte FROM (SELECT run_id, dte FROM contracts WHERE iv > 0.001e0 AND iv < 5 GROUP BY ALL HAVING count(*) >= 4) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY abs(dte - 30), dte) = 1),
c AS (SELECT c.* FROM contracts c JOIN e USING (run_id, dte)),
p AS (SELECT run_id, dte, spot, min_by(iv, abs(strike - spot) * 1e6 + strike) FILTER (is_call) AS cn, min_by(iv, abs(strike - spot) * 1e6 + strike) FILTER (NOT is_call) AS pn,
  arg_min(iv, abs(abs(delta) - 0.25e0)) FILTER (is_call AND delta BETWEEN 0.1e0 AND 0.4e0) AS c25, arg_min(iv, abs(abs(delta) - 0.25e0)) FILTER (NOT is_call AND delta BETWEEN -0.4e0 AND -0.1e0) AS p25 FROM c GROUP BY ALL),
s AS (SELECT *, (cn + pn) / 2 AS atm, p25 - c25 AS rr FROM p)
SELECT run_id, dte, {sql_round('atm', 6)} AS atm_iv, {sql_round('c25 - atm', 6)} AS call_skew, {sql_round('p25 - atm', 6)} AS put_skew, {sql_round('rr', 6)} AS rr_skew,
  {sql_round('(rank() OVER (ORDER BY round(rr, 9)) + (count(*) OVER (PARTITION BY round(rr, 9)) - 1) / 2e0) / (count(*) OVER () + 1)', 6)} AS rr_rank FROM s""")
def skew_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew of the expiration nearest 30 days, per run, with its average rank."""
    c = contracts(spark, sf_dir).where((F.col("iv") > 0.001) & (F.col("iv") < 5))
    e = c.groupBy("run_id", "dte").count().where("count >= 4").groupBy("run_id").agg(F.min_by("dte", F.struct(F.abs(F.col("dte") - 30), F.col("dte"))).alias("dte"))
    x = c.join(e, ["run_id", "dte"])
    near = F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))
    off = F.struct(F.abs(F.abs("delta") - F.lit(0.25)), F.col("strike"))
    pick = lambda ok, key: F.min_by(F.when(ok, F.col("iv")), F.when(ok, key))
    call = F.col("is_call")
    p = x.groupBy("run_id", "dte", "spot").agg(pick(call, near).alias("cn"), pick(~call, near).alias("pn"), pick(call & F.col("delta").between(F.lit(0.1), F.lit(0.4)), off).alias("c25"), pick(~call & F.col("delta").between(F.lit(-0.4), F.lit(-0.1)), off).alias("p25"))
    s = p.withColumns({"atm": (F.col("cn") + F.col("pn")) / 2, "rr": F.round(F.col("p25") - F.col("c25"), 9)})
    everyone = Window.partitionBy(F.lit(0))  # one row per run
    rank = (F.rank().over(everyone.orderBy("rr")) + (F.count("*").over(Window.partitionBy("rr")) - 1) / F.lit(2.0)) / (F.count("*").over(everyone) + 1)
    return s.select("run_id", "dte", js_round(F.col("atm"), 6).alias("atm_iv"), js_round(F.col("c25") - F.col("atm"), 6).alias("call_skew"), js_round(F.col("p25") - F.col("atm"), 6).alias("put_skew"), js_round(F.col("p25") - F.col("c25"), 6).alias("rr_skew"), js_round(rank, 6).alias("rr_rank"))


def priced(c: DataFrame) -> DataFrame:
    """Adds price: closed form; every seventh strike has no quote, so that fallbacks matter."""
    return c.withColumn("price", bs_price(F.col("spot"), F.col("strike"), F.col("tau"), F.col("iv"), F.col("is_call")))


D2_SQL = "(d1 - iv * sqrt(tau))"
PRICED_SQL = f"""{CONTRACTS_SQL}, priced AS (SELECT *, spot * {sql_cdf('d1')} - strike * exp(-0.045e0 * tau) * {sql_cdf(D2_SQL)} - CASE WHEN is_call THEN 0e0 ELSE spot - strike * exp(-0.045e0 * tau) END AS price FROM contracts)"""


@query(f"""WITH {PRICED_SQL}, q AS (SELECT *, CASE WHEN CAST(strike AS INTEGER) % 7 <> 0 THEN price - 0.05e0 END AS bid, CASE WHEN CAST(strike AS INTEGER) % 7 <> 0 THEN price + 0.05e0 END AS ask, CASE WHEN CAST(strike AS INTEGER) % 2 = 0 THEN price END AS last FROM priced),
b AS (SELECT run_id, spot, dte, strike, max(coalesce((bid + ask) / 2, last, price)) FILTER (is_call) AS c, max(coalesce((bid + ask) / 2, last, price)) FILTER (NOT is_call) AS p, avg(iv) AS iv FROM q GROUP BY ALL HAVING c IS NOT NULL AND p IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dte, abs(strike - spot), strike) AS n FROM b)
SELECT run_id, dte, strike, {sql_round('c + p', 4)} AS straddle_mid, {sql_round('0.85e0 * (c + p)', 4)} AS implied_range, {sql_round('0.85e0 * (c + p) / spot', 6)} AS implied_move, {sql_round('iv', 6)} AS atm_iv FROM r WHERE n = 1""")
def implied_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implied move from the at-the-money straddle of the first expiration with a common strike; mid, then last, then model price."""
    c = priced(contracts(spark, sf_dir))
    whole = F.col("strike").cast("int")
    quote = F.when(whole % 7 != 0, ((F.col("price") - 0.05) + (F.col("price") + 0.05)) / 2)
    mid = F.coalesce(quote, F.when(whole % 2 == 0, F.col("price")), F.col("price"))
    pairs = c.groupBy("run_id", "spot", "dte", "strike").agg(F.max(F.when(F.col("is_call"), mid)).alias("c"), F.max(F.when(~F.col("is_call"), mid)).alias("p"), F.avg("iv").alias("iv")).where("c is not null and p is not null")
    best = pairs.groupBy("run_id", "spot").agg(F.min_by(F.struct("dte", "strike", "c", "p", "iv"), F.struct("dte", F.abs(F.col("strike") - F.col("spot")), "strike")).alias("b")).select("run_id", "spot", "b.*")
    s = F.col("c") + F.col("p")
    return best.select("run_id", "dte", "strike", js_round(s, 4).alias("straddle_mid"), js_round(s * 0.85, 4).alias("implied_range"), js_round(s * 0.85 / F.col("spot"), 6).alias("implied_move"), js_round(F.col("iv"), 6).alias("atm_iv"))


@query(f"""WITH {PRICED_SQL}, m AS (SELECT run_id, spot, dte, strike, max(price) FILTER (is_call) AS c, max(price) FILTER (NOT is_call) AS p FROM priced WHERE price > 0 GROUP BY ALL HAVING c IS NOT NULL AND p IS NOT NULL),
b AS (SELECT run_id, spot, dte, count(*) AS n, max(strike) FILTER (strike <= spot) AS k1, min(strike) FILTER (strike > spot) AS k2 FROM m GROUP BY ALL),
x AS (SELECT b.run_id, b.spot, b.dte, b.dte / 365e0 AS t, k1, k2, a.c AS c1, a.p AS p1, d.c AS c2, d.p AS p2 FROM b JOIN m a ON a.run_id = b.run_id AND a.dte = b.dte AND a.strike = k1 JOIN m d ON d.run_id = b.run_id AND d.dte = b.dte AND d.strike = k2 WHERE n >= 2 AND b.dte >= 1),
r AS (SELECT *, (c1 - p1) - (c2 - p2) AS box FROM x), y AS (SELECT *, ln((k2 - k1) / box) / t AS rbox, ln(k1 / (spot - c1 + p1)) / t AS r1, ln(k2 / (spot - c2 + p2)) / t AS r2 FROM r WHERE box > 0)
SELECT run_id, dte, k1, k2, {sql_round('box', 5)} AS box_cost, {sql_round('rbox', 6)} AS box_rate, {sql_round('0.5e0 * (r1 + r2)', 6)} AS parity_rate, {sql_round('abs(r1 - r2)', 6)} AS parity_spread, {sql_round('k1 + (c1 - p1) * exp(rbox * t)', 4)} AS forward FROM y""")
def box_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates implied by boxes and by put-call parity around the money, and the forward, per expiration."""
    c = priced(contracts(spark, sf_dir)).where("price > 0")
    m = c.groupBy("run_id", "spot", "dte", "strike").agg(F.max(F.when(F.col("is_call"), F.col("price"))).alias("c"), F.max(F.when(~F.col("is_call"), F.col("price"))).alias("p")).where("c is not null and p is not null")
    leg = F.struct("strike", "c", "p")
    b = m.groupBy("run_id", "spot", "dte").agg(F.count("*").alias("n"), F.max(F.when(F.col("strike") <= F.col("spot"), leg)).alias("a"), F.min(F.when(F.col("strike") > F.col("spot"), leg)).alias("d"))
    b = b.where("n >= 2 and dte >= 1 and a is not null and d is not null")
    t, spread = F.col("dte") / F.lit(365.0), F.col("d.strike") - F.col("a.strike")
    box = (F.col("a.c") - F.col("a.p")) - (F.col("d.c") - F.col("d.p"))
    parity = lambda s: F.log(F.col(f"{s}.strike") / (F.col("spot") - F.col(f"{s}.c") + F.col(f"{s}.p"))) / t
    y = b.withColumn("box", box).where("box > 0").withColumns({"rbox": F.log(spread / F.col("box")) / t, "r1": parity("a"), "r2": parity("d")})
    return y.select("run_id", "dte", F.col("a.strike").alias("k1"), F.col("d.strike").alias("k2"), js_round(F.col("box"), 5).alias("box_cost"), js_round(F.col("rbox"), 6).alias("box_rate"), js_round((F.col("r1") + F.col("r2")) * 0.5, 6).alias("parity_rate"), js_round(F.abs(F.col("r1") - F.col("r2")), 6).alias("parity_spread"), js_round(F.col("a.strike") + (F.col("a.c") - F.col("a.p")) * F.exp(F.col("rbox") * t), 4).alias("forward"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of ingest runs: captured_at, trading_date (UTC-5), status, spot."""
    e = events(spark, sf_dir)
    return e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("captured_at"), F.to_date(F.col("ts") - F.expr("INTERVAL 5 HOURS")).alias("trading_date"), F.when(F.col("event_id") % 20 == 0, "partial").otherwise("success").alias("status"), F.col("value").alias("spot"), (F.col("event_id") % 50 != 0).alias("has_atm"))


RUNS_SQL = "runs AS (SELECT event_id AS run_id, ts AS captured_at, CAST(ts - INTERVAL 5 HOUR AS DATE) AS trading_date, CASE WHEN event_id % 20 = 0 THEN 'partial' ELSE 'success' END AS status, value AS spot, event_id % 50 <> 0 AS has_atm FROM events)"


@query(f"""WITH {RUNS_SQL}, d AS (SELECT trading_date, count(*) AS n, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status <> 'success') AS bad, count(*) FILTER (status = 'success' AND NOT has_atm) AS gaps,
    max(captured_at) FILTER (status = 'success') AS last_at, max_by(spot, captured_at) FILTER (status = 'success') AS last_spot, avg(spot) AS day_avg FROM runs GROUP BY 1),
p AS (SELECT trading_date, 'spx_close_xcheck' AS check_name, last_spot AS observed, CASE WHEN abs(last_spot / day_avg - 1) * 100 < 0.2e0 THEN 'pass' WHEN abs(last_spot / day_avg - 1) * 100 < 1 THEN 'warn' ELSE 'fail' END AS status FROM d
UNION ALL SELECT trading_date, 'run_count', ok, CASE WHEN ok BETWEEN 78 AND 90 THEN 'pass' WHEN ok BETWEEN 60 AND 110 THEN 'warn' ELSE 'fail' END FROM d
UNION ALL SELECT trading_date, 'partial_rate', bad * 1e2 / n, CASE WHEN bad * 1e2 / n < 5 THEN 'pass' WHEN bad * 1e2 / n < 10 THEN 'warn' ELSE 'fail' END FROM d
UNION ALL SELECT trading_date, 'atm_iv_null_rate', gaps * 1e2 / ok, CASE WHEN gaps * 1e2 / ok < 1 THEN 'pass' WHEN gaps * 1e2 / ok < 5 THEN 'warn' ELSE 'fail' END FROM d WHERE ok > 0
UNION ALL SELECT trading_date, 'late_snapshot', (epoch_us(last_at) - epoch_us(CAST(trading_date AS TIMESTAMP) + INTERVAL '21 hours 30 minutes')) / 6e7, CASE WHEN last_at >= CAST(trading_date AS TIMESTAMP) + INTERVAL '21 hours 30 minutes' THEN 'pass' WHEN last_at >= CAST(trading_date AS TIMESTAMP) + INTERVAL 21 HOUR THEN 'warn' ELSE 'fail' END FROM d WHERE ok > 0)
SELECT trading_date, check_name, {sql_round('observed', 4)} AS observed, status FROM p""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five data-quality probes per trading day, each pass, warn or fail."""
    r = run_log(spark, sf_dir)
    ok = F.col("status") == "success"
    d = r.groupBy("trading_date").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"), F.count_if(ok & ~F.col("has_atm")).alias("gaps"), F.max(F.when(ok, F.struct("captured_at", "spot"))).alias("last"), F.avg("spot").alias("avg"))
    band = lambda x, a, b: F.when(x < a, "pass").when(x < b, "warn").otherwise("fail")
    close = F.to_utc_timestamp(F.col("trading_date").cast("timestamp") + F.expr("INTERVAL 16 HOURS 30 MINUTES"), "GMT-5")
    lag = (F.unix_micros("last.captured_at") - F.unix_micros(close)) / F.lit(6e7)
    partial, gaps, gap = F.col("bad") * 100.0 / F.col("n"), F.when(F.col("ok") > 0, F.col("gaps") * 100.0 / F.col("ok")), F.abs(F.col("last.spot") / F.col("avg") - 1) * 100
    probes = [
        ("spx_close_xcheck", F.col("last.spot"), band(gap, 0.2, 1)),
        ("run_count", F.col("ok").cast("double"), F.when(F.col("ok").between(78, 90), "pass").when(F.col("ok").between(60, 110), "warn").otherwise("fail")),
        ("partial_rate", partial, band(partial, 5, 10)),
        ("atm_iv_null_rate", gaps, band(gaps, 1, 5)),
        ("late_snapshot", lag, F.when(lag >= 0, "pass").when(lag >= -30, "warn").otherwise("fail")),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), o.alias("observed"), s.alias("status")) for n, o, s in probes))
    return d.select("trading_date", F.inline(rows)).where("observed is not null").select("trading_date", "check_name", js_round(F.col("observed"), 4).alias("observed"), "status")


@query(f"""WITH {WALLS_SQL}, g AS (SELECT run_id, sum(call_gex) - sum(put_gex) AS net FROM strikes GROUP BY 1), w AS (SELECT walls.*, net FROM walls JOIN g USING (run_id)), l AS (SELECT *, lag(spot) OVER o AS spot0, lag(call_wall) OVER o AS call0, lag(put_wall) OVER o AS put0, lag(net) OVER o AS net0 FROM w WINDOW o AS (ORDER BY trading_date))
SELECT trading_date, spot, call_wall, put_wall, {sql_round('net', 3)} AS net_gex, spot - spot0 AS spot_change, call_wall - call0 AS call_wall_change, put_wall - put0 AS put_wall_change, {sql_round('net - net0', 3)} AS net_gex_change,
  CASE WHEN spot0 IS NOT NULL THEN CAST(sign(spot - spot0) + sign(call_wall - call0) + sign(put_wall - put0) AS INTEGER) END AS overnight_alignment FROM l""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of each day against the day before, and how many of spot and walls moved together (-3 to 3)."""
    s = by_strike(contracts(spark, sf_dir))
    w = wall_levels(s, 0.15).join(s.groupBy("run_id").agg((F.sum("call_gex") - F.sum("put_gex")).alias("net")), "run_id")
    days = Window.orderBy("trading_date")  # one row per day
    change = {c: F.col(c) - F.lag(c).over(days) for c in ("spot", "call_wall", "put_wall", "net")}
    w = w.withColumns({f"d_{c}": x for c, x in change.items()})
    return w.select("trading_date", "spot", "call_wall", "put_wall", js_round(F.col("net"), 3).alias("net_gex"), F.col("d_spot").alias("spot_change"), F.col("d_call_wall").alias("call_wall_change"), F.col("d_put_wall").alias("put_wall_change"), js_round(F.col("d_net"), 3).alias("net_gex_change"), (F.signum("d_spot") + F.signum("d_call_wall") + F.signum("d_put_wall")).cast("int").alias("overnight_alignment"))


@query(f"""WITH {METRICS_SQL}, {RUNS_SQL}, closes AS (SELECT trading_date, max_by(spot, captured_at) AS close FROM runs WHERE status = 'success' GROUP BY 1),
asked AS (SELECT run_id, expiration_date, dte, DATE '2024-01-03' + run_id * 3 AS as_of FROM metrics)
SELECT run_id, expiration_date, as_of, (SELECT max(c.trading_date) FROM closes c WHERE c.trading_date <= as_of) AS band_date, (SELECT {sql_round('max_by(c.close, c.trading_date)', 6)} FROM closes c WHERE c.trading_date <= as_of) AS band_value FROM asked""")
def as_of_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each expiration of a run with the latest daily level at or before the run's date (as-of join)."""
    m = expiration_metrics_of(contracts(spark, sf_dir)).select("run_id", "expiration_date", F.date_add(F.lit("2024-01-03").cast("date"), F.col("run_id") * 3).alias("as_of"))
    closes = run_log(spark, sf_dir).where("status = 'success'").groupBy("trading_date").agg(F.max_by("spot", "captured_at").alias("close"))
    j = as_of(m, closes.withColumn("band_date", F.col("trading_date")), "as_of", "trading_date", ["band_date", "close"])
    return j.select("run_id", "expiration_date", "as_of", "band_date", js_round(F.col("close"), 6).alias("band_value"))


@query(f"""WITH {STRIKES_SQL}, a AS (SELECT run_id, strike, call_gex - put_gex AS net FROM strikes), b AS (SELECT run_id + 1 AS run_id, strike, net AS before FROM a), j AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.strike, b.strike) AS strike, net, before FROM a FULL JOIN b ON a.run_id = b.run_id AND a.strike = b.strike)
SELECT run_id, count(*) AS keys, count(*) FILTER (net IS NULL OR before IS NULL) AS unmatched, count(*) FILTER (abs(net - before) < 0.5e0) AS identical, count(*) FILTER (abs(net - before) >= 0.5e0 AND abs(net - before) < 50) AS small, count(*) FILTER (abs(net - before) >= 50) AS big, count(*) FILTER (sign(net) <> sign(before)) AS sign_flips FROM j GROUP BY 1""")
def impact_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed comparison of one run's exposures with the previous run's: identical, small and big changes, sign flips."""
    a = by_strike(contracts(spark, sf_dir)).select("run_id", "strike", (F.col("call_gex") - F.col("put_gex")).alias("net"))
    b = a.select((F.col("run_id") + 1).alias("run_id"), "strike", F.col("net").alias("before"))
    d = F.abs(F.col("net") - F.col("before"))
    return a.join(b, ["run_id", "strike"], "full_outer").groupBy("run_id").agg(F.count("*").alias("keys"), F.count_if(d.isNull()).alias("unmatched"), F.count_if(d < 0.5).alias("identical"), F.count_if((d >= 0.5) & (d < 50)).alias("small"), F.count_if(d >= 50).alias("big"), F.count_if(F.signum("net") != F.signum("before")).alias("sign_flips"))
