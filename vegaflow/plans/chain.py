"""Option-chain queries: exposure by strike, walls, gamma profile and flip, chain aggregates, nearest quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.numeric import RISK_FREE, bs_charm, bs_vanna, js_round, norm_pdf, safe_divide
from vegaflow.plans.registry import query
from vegaflow.sources.fixtures import CONTRACTS_SQL, RAW_SQL, contracts, raw_chain, sql_pdf, sql_round


def gex() -> Column:
    """Dollar gamma of a contract for a move of one percent, in millions."""
    return F.col("gamma") * F.col("open_interest") * 100 * F.col("spot") * F.col("spot") * F.lit(0.01) / F.lit(1e6)


GEX_SQL = "(gamma * open_interest * 100 * spot * spot * 0.01e0 / 1e6)"


def by_strike(c: DataFrame) -> DataFrame:
    """Call and put dollar gamma (millions) of each strike of a run."""
    return c.groupBy("run_id", "trading_date", "spot", "strike").agg(
        F.sum(F.when(F.col("is_call"), gex()).otherwise(0.0)).alias("call_gex"), F.sum(F.when(F.col("is_call"), 0.0).otherwise(gex())).alias("put_gex")
    )


STRIKES_SQL = f"""{CONTRACTS_SQL}, strikes AS (
  SELECT run_id, trading_date, spot, strike, sum(CASE WHEN is_call THEN {GEX_SQL} ELSE 0e0 END) AS call_gex,
    sum(CASE WHEN is_call THEN 0e0 ELSE {GEX_SQL} END) AS put_gex FROM contracts GROUP BY ALL)"""


@query(f"WITH {STRIKES_SQL} SELECT run_id, strike, {sql_round('call_gex', 3)} AS call_gex, {sql_round('put_gex', 3)} AS put_gex, {sql_round('call_gex - put_gex', 3)} AS net_gex FROM strikes")
def gex_by_strike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealer gamma exposure by strike."""
    s = by_strike(contracts(spark, sf_dir))
    return s.select("run_id", "strike", js_round(F.col("call_gex"), 3).alias("call_gex"), js_round(F.col("put_gex"), 3).alias("put_gex"), js_round(F.col("call_gex") - F.col("put_gex"), 3).alias("net_gex"))


def wall_levels(s: DataFrame, window: float | None) -> DataFrame:
    """Strikes of greatest and least net exposure (within the window around spot) and of greatest total; ties to the lower strike."""
    net = F.col("call_gex") - F.col("put_gex")
    inside = F.lit(True) if window is None else F.col("strike").between(F.col("spot") * F.lit(1 - window), F.col("spot") * F.lit(1 + window))
    low = -F.col("strike")
    return s.groupBy("run_id", "trading_date", "spot").agg(
        F.max(F.when(inside, F.struct(net.alias("v"), low.alias("k")))).alias("c"),
        F.min(F.when(inside, F.struct(net.alias("v"), F.col("strike").alias("k")))).alias("p"),
        F.max(F.when(F.col("call_gex") + F.col("put_gex") > 0, F.struct((F.col("call_gex") + F.col("put_gex")).alias("v"), low.alias("k")))).alias("a"),
    ).select("run_id", "trading_date", "spot", (-F.col("c.k")).alias("call_wall"), F.col("p.k").alias("put_wall"), (-F.col("a.k")).alias("abs_gamma_strike"))


def walls_sql(inside: str) -> str:
    return f"""{STRIKES_SQL}, ranked AS (
  SELECT *, {inside} AS inside, row_number() OVER (PARTITION BY run_id, {inside} ORDER BY call_gex - put_gex DESC, strike) AS rc,
    row_number() OVER (PARTITION BY run_id, {inside} ORDER BY call_gex - put_gex, strike) AS rp,
    row_number() OVER (PARTITION BY run_id ORDER BY call_gex + put_gex DESC, strike) AS ra FROM strikes
), walls AS (
  SELECT run_id, trading_date, spot, max(CASE WHEN inside AND rc = 1 THEN strike END) AS call_wall, max(CASE WHEN inside AND rp = 1 THEN strike END) AS put_wall,
    max(CASE WHEN ra = 1 AND call_gex + put_gex > 0 THEN strike END) AS abs_gamma_strike FROM ranked GROUP BY ALL)"""


WALLS_SQL = walls_sql("(strike BETWEEN spot * (1 - 0.15e0) AND spot * (1 + 0.15e0))")


@query(f"WITH {WALLS_SQL} SELECT run_id, call_wall, put_wall, abs_gamma_strike FROM walls")
def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call and put walls within 15 % of spot and the strike of greatest gamma."""
    return wall_levels(by_strike(contracts(spark, sf_dir)), 0.15).drop("trading_date", "spot")


@query(f"WITH {walls_sql('(strike > 0)')} SELECT run_id, trading_date, call_wall, put_wall FROM walls")
def walls_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls over all strikes, as the history rebuild has them."""
    return wall_levels(by_strike(contracts(spark, sf_dir)), None).select("run_id", "trading_date", "call_wall", "put_wall")


def profile(c: DataFrame) -> DataFrame:
    """Dealer gamma at hypothetical spots within 15 %, every 5 points.

    Each contract explodes into its run's grid and sums are pre-aggregated in
    the map tasks: no join, and the shuffle carries one row per task and grid point.
    """
    step = F.lit(5)
    lo, hi = (js_round(F.col("spot") * F.lit(f) / step).cast("int") * step for f in (0.85, 1.15))
    b = F.col("iv") * F.sqrt("tau")
    ready = c.where((F.col("iv") > 0) & (F.col("open_interest") > 0) & (F.col("strike") > 0) & (F.col("tau") > 0)).select(
        "run_id",
        "spot",
        ((F.lit(RISK_FREE) + F.lit(0.5) * F.col("iv") * F.col("iv")) * F.col("tau") - F.log("strike")).alias("d"),
        b.alias("b"),
        (F.col("open_interest") * F.when(F.col("is_call"), 1.0).otherwise(-1.0) / b).alias("scale"),
        F.explode(F.sequence(lo, hi, step)).alias("s"),
    )
    d1 = (F.log(F.col("s").cast("double")) + F.col("d")) / F.col("b")
    return ready.groupBy("run_id", "spot", "s").agg(F.sum(F.col("scale") * norm_pdf(d1)).alias("g")).select("run_id", "spot", "s", js_round(F.col("s") * F.col("g")).alias("g"))


PROFILE_SQL = f"""{CONTRACTS_SQL}, grid AS (
  SELECT run_id, spot, unnest(generate_series(CAST(floor(spot * 0.85e0 / 5 + 0.5e0) AS INTEGER) * 5, CAST(floor(spot * 1.15e0 / 5 + 0.5e0) AS INTEGER) * 5, 5)) AS s
  FROM (SELECT DISTINCT run_id, spot FROM contracts)
), profile AS (
  SELECT run_id, g.spot, CAST(s AS INTEGER) AS s, floor(s * sum(CASE WHEN is_call THEN 1e0 ELSE -1e0 END * open_interest / (iv * sqrt(tau))
      * {sql_pdf("(ln(s::DOUBLE) + (0.045e0 + 0.5e0 * iv * iv) * tau - ln(strike)) / (iv * sqrt(tau))")}) + 0.5e0) AS g
  FROM contracts JOIN grid g USING (run_id) WHERE open_interest > 0 GROUP BY run_id, g.spot, s)"""


@query(f"WITH {PROFILE_SQL} SELECT run_id, s, g FROM profile")
def gamma_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gamma profile of each run."""
    return profile(contracts(spark, sf_dir)).select("run_id", "s", "g")


def flips(p: DataFrame) -> DataFrame:
    """The zero crossing with the largest absolute prefix sum before it; the first of equals."""
    w = Window.partitionBy("run_id").orderBy("s")
    before = F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = p.withColumns({"s0": F.lag("s").over(w), "g0": F.lag("g").over(w), "score": F.abs(before)})
    x = x.where(F.col("g0").isNotNull() & (F.signum("g0") != F.signum("g")))
    at = F.when(F.col("g") == F.col("g0"), F.col("s0").cast("double")).otherwise(F.col("s0") - F.col("g0") / (F.col("g") - F.col("g0")) * (F.col("s") - F.col("s0")))
    best = x.groupBy("run_id").agg(F.max(F.struct("score", (-F.col("s")).alias("first"), at.alias("flip"))).alias("b"))
    return p.select("run_id", "spot").distinct().join(best, "run_id", "left").select("run_id", "spot", F.col("b.flip").alias("vol_flip"))


FLIP_SQL = f"""{PROFILE_SQL}, crossings AS (
  SELECT *, lag(s) OVER w AS s0, lag(g) OVER w AS g0, abs(sum(g) OVER (PARTITION BY run_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS score
  FROM profile WINDOW w AS (PARTITION BY run_id ORDER BY s)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, s) AS r FROM crossings WHERE g0 IS NOT NULL AND sign(g0) <> sign(g)
), flip AS (
  SELECT r.run_id, r.spot, CASE WHEN g = g0 THEN s0 ELSE s0 - g0 / (g - g0) * (s - s0) END AS vol_flip
  FROM (SELECT DISTINCT run_id, spot FROM profile) r LEFT JOIN best b ON b.run_id = r.run_id AND b.r = 1)"""


@query(f"WITH {FLIP_SQL} SELECT run_id, spot, {sql_round('vol_flip', 4)} AS vol_flip, CASE WHEN abs(spot / vol_flip - 1) < 0.002e0 THEN 'near_flip' WHEN spot >= vol_flip THEN 'positive' ELSE 'negative' END AS regime FROM flip")
def vol_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility flip and gamma regime of each run."""
    f = flips(profile(contracts(spark, sf_dir)))
    regime = F.when(F.abs(F.col("spot") / F.col("vol_flip") - 1) < F.lit(0.002), "near_flip").when(F.col("spot") >= F.col("vol_flip"), "positive").otherwise("negative")
    return f.select("run_id", "spot", js_round(F.col("vol_flip"), 4).alias("vol_flip"), regime.alias("regime"))


def chain_totals(c: DataFrame) -> DataFrame:
    """Per run: dollar gamma in all and at the money, open interest, volume, vanna and charm."""
    call = F.col("is_call")
    at_money = F.abs("delta").between(F.lit(0.4), F.lit(0.6))
    args = (F.col("spot"), F.col("strike"), F.col("tau"), F.col("iv"))
    notional = F.col("open_interest") * 100 * F.col("spot") * F.when(call, 1.0).otherwise(-1.0) / F.lit(1e6)
    zero = F.lit(0.0)
    return c.groupBy("run_id", "trading_date", "spot").agg(
        F.sum(F.when(call, gex()).otherwise(zero)).alias("call_gex"),
        F.sum(F.when(call, zero).otherwise(gex())).alias("put_gex"),
        F.sum(F.when(call & at_money, gex()).otherwise(zero)).alias("atm_call_gex"),
        F.sum(F.when(~call & at_money, gex()).otherwise(zero)).alias("atm_put_gex"),
        F.count_if(at_money).alias("atm_contract_count"),
        F.count("*").alias("contract_count"),
        F.countDistinct("expiration_date").alias("expiration_count"),
        F.sum(F.when(call, F.col("open_interest")).otherwise(0)).alias("call_oi"),
        F.sum(F.when(call, 0).otherwise(F.col("open_interest"))).alias("put_oi"),
        F.sum(F.when(call, F.col("volume")).otherwise(0)).alias("call_volume"),
        F.sum(F.when(call, 0).otherwise(F.col("volume"))).alias("put_volume"),
        F.sum(bs_vanna(*args) * notional).alias("net_vanna"),
        F.sum(bs_charm(*args) * notional).alias("net_charm"),
    )


def gamma_index(atm_call, atm_put, atm_count, call, put, count, least_atm: int = 50, least: int = 1000):
    """10 (C - P) / (C + P) at the money if that has 50 contracts, else over the chain if it has 1000."""
    return F.when((atm_call + atm_put > 0) & (atm_count >= least_atm), (atm_call - atm_put) / (atm_call + atm_put) * 10).when((call + put > 0) & (count >= least), (call - put) / (call + put) * 10)


TOTALS_SQL = f"""{CONTRACTS_SQL}, totals AS (
  SELECT run_id, trading_date, spot, sum(CASE WHEN is_call THEN {GEX_SQL} ELSE 0e0 END) AS call_gex, sum(CASE WHEN is_call THEN 0e0 ELSE {GEX_SQL} END) AS put_gex,
    sum(CASE WHEN is_call AND abs(delta) BETWEEN 0.4e0 AND 0.6e0 THEN {GEX_SQL} ELSE 0e0 END) AS atm_call_gex,
    sum(CASE WHEN NOT is_call AND abs(delta) BETWEEN 0.4e0 AND 0.6e0 THEN {GEX_SQL} ELSE 0e0 END) AS atm_put_gex,
    count(*) FILTER (abs(delta) BETWEEN 0.4e0 AND 0.6e0) AS atm_contract_count, count(*) AS contract_count, count(DISTINCT expiration_date) AS expiration_count,
    CAST(sum(open_interest) FILTER (is_call) AS BIGINT) AS call_oi, CAST(sum(open_interest) FILTER (NOT is_call) AS BIGINT) AS put_oi,
    CAST(sum(volume) FILTER (is_call) AS BIGINT) AS call_volume, CAST(sum(volume) FILTER (NOT is_call) AS BIGINT) AS put_volume,
    sum(-{sql_pdf("d1")} * (d1 - iv * sqrt(tau)) / iv / 100 * open_interest * 100 * spot * CASE WHEN is_call THEN 1e0 ELSE -1e0 END / 1e6) AS net_vanna,
    sum(-{sql_pdf("d1")} * (0.09e0 * tau - (d1 - iv * sqrt(tau)) * iv * sqrt(tau)) / (2 * tau * iv * sqrt(tau)) / 365 * open_interest * 100 * spot * CASE WHEN is_call THEN 1e0 ELSE -1e0 END / 1e6) AS net_charm
  FROM contracts GROUP BY ALL)"""


@query(f"""WITH {TOTALS_SQL} SELECT run_id, call_oi, put_oi, call_volume, put_volume, {sql_round('put_oi / call_oi', 6)} AS put_call_ratio_oi,
  {sql_round('put_volume / call_volume', 6)} AS put_call_ratio_volume, {sql_round('net_vanna', 3)} AS net_vanna, {sql_round('net_charm', 3)} AS net_charm,
  {sql_round('atm_call_gex', 3)} AS atm_call_gex, {sql_round('atm_put_gex', 3)} AS atm_put_gex, atm_contract_count FROM totals""")
def chain_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put/call ratios, net vanna and charm, at-the-money exposure."""
    t = chain_totals(contracts(spark, sf_dir))
    ratio = lambda a, b: js_round(safe_divide(F.col(a), F.col(b)), 6)
    return t.select("run_id", "call_oi", "put_oi", "call_volume", "put_volume", ratio("put_oi", "call_oi").alias("put_call_ratio_oi"), ratio("put_volume", "call_volume").alias("put_call_ratio_volume"), *(js_round(F.col(c), 3).alias(c) for c in ("net_vanna", "net_charm", "atm_call_gex", "atm_put_gex")), "atm_contract_count")


INDEX_SQL = "CASE WHEN atm_call_gex + atm_put_gex > 0 AND atm_contract_count >= 50 THEN (atm_call_gex - atm_put_gex) / (atm_call_gex + atm_put_gex) * 10 WHEN call_gex + put_gex > 0 AND contract_count >= 1000 THEN (call_gex - put_gex) / (call_gex + put_gex) * 10 END"


@query(f"""WITH {TOTALS_SQL}, {FLIP_SQL.removeprefix(CONTRACTS_SQL + ', ')}, {WALLS_SQL.removeprefix(CONTRACTS_SQL + ', ')}
  SELECT t.trading_date, t.spot AS spx_close, {sql_round('call_gex - put_gex', 3)} AS net_gex, {sql_round('vol_flip', 4)} AS vol_flip_strike, call_wall, put_wall,
  atm_contract_count, contract_count, expiration_count, {sql_round(INDEX_SQL, 4)} AS gamma_index,
  CASE WHEN vol_flip IS NOT NULL THEN CASE WHEN t.spot >= vol_flip THEN 'positive' ELSE 'negative' END WHEN call_gex >= put_gex THEN 'positive' ELSE 'negative' END AS regime
  FROM totals t JOIN flip USING (run_id) JOIN walls USING (run_id)""")
def daily_gex_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily exposure statistics: totals, flip, walls, Gamma Index and regime."""
    c = contracts(spark, sf_dir)
    t, f, w = chain_totals(c), flips(profile(c)).drop("spot"), wall_levels(by_strike(c), 0.15).select("run_id", "call_wall", "put_wall")
    j = t.join(f, "run_id").join(w, "run_id")
    index = gamma_index(*(F.col(x) for x in ("atm_call_gex", "atm_put_gex", "atm_contract_count", "call_gex", "put_gex", "contract_count")))
    regime = F.when(F.col("vol_flip").isNotNull(), F.when(F.col("spot") >= F.col("vol_flip"), "positive").otherwise("negative")).when(F.col("call_gex") >= F.col("put_gex"), "positive").otherwise("negative")
    return j.select("trading_date", F.col("spot").alias("spx_close"), js_round(F.col("call_gex") - F.col("put_gex"), 3).alias("net_gex"), js_round(F.col("vol_flip"), 4).alias("vol_flip_strike"), "call_wall", "put_wall", "atm_contract_count", "contract_count", "expiration_count", js_round(index, 4).alias("gamma_index"), regime.alias("regime"))


@query(f"""WITH {CONTRACTS_SQL}, exps AS (
  SELECT run_id, min(dte) AS dte FROM (SELECT run_id, dte FROM contracts WHERE is_call GROUP BY ALL HAVING count(*) >= 5) GROUP BY 1
), calls AS (
  SELECT c.*, lead(delta) OVER w AS delta2, lead(strike) OVER w AS strike2, lead(iv) OVER w AS iv2 FROM contracts c JOIN exps USING (run_id, dte) WHERE is_call
  WINDOW w AS (PARTITION BY run_id ORDER BY strike)
), picked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN delta >= 0.5e0 AND delta2 <= 0.5e0 AND delta > delta2 THEN 0 ELSE 1 END,
    CASE WHEN delta >= 0.5e0 AND delta2 <= 0.5e0 AND delta > delta2 THEN 0e0 ELSE abs(delta - 0.5e0) END, strike) AS r FROM calls
), spots AS (
  SELECT run_id, spot, tau, CASE WHEN delta >= 0.5e0 AND delta2 <= 0.5e0 AND delta > delta2 THEN strike + (delta - 0.5e0) / (delta - delta2) * (strike2 - strike) ELSE strike END AS k,
    CASE WHEN delta >= 0.5e0 AND delta2 <= 0.5e0 AND delta > delta2 THEN iv + (delta - 0.5e0) / (delta - delta2) * (iv2 - iv) ELSE iv END AS sigma FROM picked WHERE r = 1)
SELECT run_id, spot, {sql_round('k * exp(-(0.045e0 + 0.5e0 * sigma * sigma) * tau)', 5)} AS inferred_spot FROM spots""")
def spot_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot from where call delta crosses one half at the nearest expiration with five calls, less drift."""
    calls = contracts(spark, sf_dir).where("is_call")
    exps = calls.groupBy("run_id", "dte").count().where("count >= 5").groupBy("run_id").agg(F.min("dte").alias("dte"))
    w = Window.partitionBy("run_id").orderBy("strike")
    x = calls.join(exps, ["run_id", "dte"]).withColumns({f"{c}2": F.lead(c).over(w) for c in ("delta", "strike", "iv")})
    brackets = F.coalesce((F.col("delta") >= 0.5) & (F.col("delta2") <= 0.5) & (F.col("delta") > F.col("delta2")), F.lit(False))
    t = F.when(brackets, (F.col("delta") - 0.5) / (F.col("delta") - F.col("delta2"))).otherwise(0.0)
    key = F.struct(F.when(brackets, 0).otherwise(1).alias("a"), F.when(brackets, 0.0).otherwise(F.abs(F.col("delta") - 0.5)).alias("b"), F.col("strike"))
    at = F.struct("spot", "tau", (F.col("strike") + t * F.coalesce(F.col("strike2") - F.col("strike"), F.lit(0.0))).alias("k"), (F.col("iv") + t * F.coalesce(F.col("iv2") - F.col("iv"), F.lit(0.0))).alias("sigma"))
    best = x.groupBy("run_id").agg(F.min_by(at, key).alias("m")).select("run_id", "m.*")
    drift = F.exp(-(F.lit(RISK_FREE) + F.lit(0.5) * F.col("sigma") * F.col("sigma")) * F.col("tau"))
    return best.select("run_id", "spot", js_round(F.col("k") * drift, 5).alias("inferred_spot"))


def expiration_metrics_of(c: DataFrame) -> DataFrame:
    """At-the-money quote (calls first), 25-delta legs and put minus call reversal of each expiration."""
    dist = F.abs(F.col("strike") - F.col("spot"))
    near = dist <= F.greatest(F.col("spot") * 0.01, F.lit(5.0))
    quote = F.struct("iv", "strike")
    off = F.abs(F.abs("delta") - F.lit(0.25))
    leg = lambda ok: F.min_by(F.when(ok, F.col("iv")), F.when(ok, F.struct(off.alias("o"), F.col("strike").alias("k"))))
    return c.groupBy("run_id", "trading_date", "spot", "expiration_date", "dte").agg(
        F.min_by(F.when(near, quote), F.when(near, F.struct((~F.col("is_call")).cast("int").alias("p"), dist.alias("d"), F.col("strike").alias("k")))).alias("atm"),
        leg(F.col("is_call") & (F.col("delta") > 0.15) & (F.col("delta") < 0.35)).alias("call_25d_iv"),
        leg(~F.col("is_call") & (F.col("delta") < -0.15) & (F.col("delta") > -0.35)).alias("put_25d_iv"),
        F.count("*").alias("contract_count"),
    ).select("run_id", "trading_date", "spot", "expiration_date", "dte", F.col("atm.iv").alias("atm_iv"), F.col("atm.strike").alias("atm_strike"), "put_25d_iv", "call_25d_iv", (F.col("put_25d_iv") - F.col("call_25d_iv")).alias("skew_25d_rr"), "contract_count")


METRICS_SQL = f"""{CONTRACTS_SQL}, nearest AS (
  SELECT *, CASE WHEN abs(strike - spot) <= greatest(spot * 0.01e0, 5e0) THEN row_number() OVER (PARTITION BY run_id, dte, abs(strike - spot) <= greatest(spot * 0.01e0, 5e0) ORDER BY is_call DESC, abs(strike - spot), strike) END AS ra,
    CASE WHEN abs(delta) > 0.15e0 AND abs(delta) < 0.35e0 THEN row_number() OVER (PARTITION BY run_id, dte, is_call, abs(delta) > 0.15e0 AND abs(delta) < 0.35e0 ORDER BY abs(abs(delta) - 0.25e0), strike) END AS rd FROM contracts
), metrics AS (
  SELECT run_id, trading_date, spot, expiration_date, dte, max(iv) FILTER (ra = 1) AS atm_iv, max(strike) FILTER (ra = 1) AS atm_strike, max(iv) FILTER (rd = 1 AND NOT is_call) AS put_25d_iv,
    max(iv) FILTER (rd = 1 AND is_call) AS call_25d_iv, max(iv) FILTER (rd = 1 AND NOT is_call) - max(iv) FILTER (rd = 1 AND is_call) AS skew_25d_rr, count(*) AS contract_count FROM nearest GROUP BY ALL)"""


@query(f"WITH {METRICS_SQL} SELECT run_id, expiration_date, {sql_round('atm_iv', 6)} AS atm_iv, atm_strike, {sql_round('put_25d_iv', 6)} AS put_25d_iv, {sql_round('call_25d_iv', 6)} AS call_25d_iv, {sql_round('skew_25d_rr', 6)} AS skew_25d_rr, contract_count FROM metrics")
def expiration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility metrics per expiration."""
    m = expiration_metrics_of(contracts(spark, sf_dir))
    return m.select("run_id", "expiration_date", js_round(F.col("atm_iv"), 6).alias("atm_iv"), "atm_strike", *(js_round(F.col(c), 6).alias(c) for c in ("put_25d_iv", "call_25d_iv", "skew_25d_rr")), "contract_count")


@query(f"""WITH {CONTRACTS_SQL}, g AS (
  SELECT run_id, expiration_date, dte, sum({GEX_SQL}) AS gamma_usd, count(*) AS n FROM contracts WHERE gamma > 0 AND open_interest > 0 GROUP BY ALL
), c AS (
  SELECT *, sum(gamma_usd) OVER (PARTITION BY run_id ORDER BY expiration_date) / sum(gamma_usd) OVER (PARTITION BY run_id) * 100 AS cumulative_pct,
    (rank() OVER (PARTITION BY dte ORDER BY gamma_usd) - 1 + 0.5e0 * count(*) OVER (PARTITION BY dte, gamma_usd)) / count(*) OVER (PARTITION BY dte) * 100 AS pct FROM g)
SELECT run_id, expiration_date, {sql_round('gamma_usd', 3)} AS gamma_usd, n AS contract_count, {sql_round('cumulative_pct', 6)} AS cumulative_pct, {sql_round('pct', 0)} AS percentile,
  CASE WHEN dte = 0 THEN '0dte' WHEN day(expiration_date) BETWEEN 15 AND 21 AND dayofweek(expiration_date) = 5 THEN CASE WHEN month(expiration_date) % 3 = 0 THEN 'quarterly' ELSE 'monthly' END ELSE 'weekly' END AS expiry_type FROM c""")
def expiring_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollar gamma that expires with each expiration, its running share, and its mid-rank among runs."""
    g = contracts(spark, sf_dir).where("gamma > 0 and open_interest > 0").groupBy("run_id", "expiration_date", "dte").agg(F.sum(gex()).alias("gamma_usd"), F.count("*").alias("contract_count"))
    run = Window.partitionBy("run_id")
    same = Window.partitionBy("dte")
    share = F.sum("gamma_usd").over(run.orderBy("expiration_date")) / F.sum("gamma_usd").over(run) * 100
    mid = (F.rank().over(same.orderBy("gamma_usd")) - 1 + F.lit(0.5) * F.count("*").over(Window.partitionBy("dte", "gamma_usd"))) / F.count("*").over(same) * 100
    third = F.dayofmonth("expiration_date").between(15, 21) & (F.dayofweek("expiration_date") == 6)
    kind = F.when(F.col("dte") == 0, "0dte").when(third & (F.month("expiration_date") % 3 == 0), "quarterly").when(third, "monthly").otherwise("weekly")
    return g.select("run_id", "expiration_date", js_round(F.col("gamma_usd"), 3).alias("gamma_usd"), "contract_count", js_round(share, 6).alias("cumulative_pct"), js_round(mid).alias("percentile"), kind.alias("expiry_type"))


@query(f"""WITH {RAW_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, dte, strike, contract_type ORDER BY l_orderkey, l_suppkey, l_extendedprice, open_interest, iv) AS n FROM raw_chain)
SELECT run_id, dte, strike, contract_type, {sql_round('iv', 6)} AS iv, open_interest, volume FROM r WHERE n = 1""")
def contract_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quote of each contract in page order."""
    first = F.min(F.struct("l_orderkey", "l_suppkey", "l_extendedprice", "open_interest", "iv", "volume")).alias("q")
    d = raw_chain(spark, sf_dir).groupBy("run_id", "dte", "strike", "contract_type").agg(first)
    return d.select("run_id", "dte", "strike", "contract_type", js_round(F.col("q.iv"), 6).alias("iv"), "q.open_interest", "q.volume")


@query(f"""WITH {CONTRACTS_SQL}, e AS (SELECT run_id, expiration_date, dense_rank() OVER (PARTITION BY run_id ORDER BY expiration_date) - 1 AS exp_index FROM (SELECT DISTINCT run_id, expiration_date FROM contracts))
SELECT c.run_id, CAST(exp_index AS INTEGER) AS exp_index, CASE WHEN is_call THEN 0 ELSE 1 END AS type_code, count(*) AS n, CAST(sum(open_interest) AS BIGINT) AS open_interest, string_agg(CAST(CAST(strike AS INTEGER) AS VARCHAR), ',' ORDER BY strike) AS strikes
FROM contracts c JOIN e USING (run_id, expiration_date) GROUP BY ALL""")
def columnar_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary-coded columns of each run's chain: expiration index, type code, ordered strikes."""
    c = contracts(spark, sf_dir)
    e = c.select("run_id", "expiration_date").distinct().withColumn("exp_index", F.dense_rank().over(Window.partitionBy("run_id").orderBy("expiration_date")) - 1)
    packed = F.array_sort(F.collect_list(F.col("strike").cast("int")))
    g = c.join(e, ["run_id", "expiration_date"]).groupBy("run_id", "exp_index", F.when(F.col("is_call"), 0).otherwise(1).alias("type_code"))
    return g.agg(F.count("*").alias("n"), F.sum("open_interest").alias("open_interest"), F.array_join(packed, ",").alias("strikes"))
