"""Endpoint payloads: exposure history, snapshot, chain payload with bands, page states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.calendar import market_holidays
from vegaflow.functions.numeric import js_round, safe_divide
from vegaflow.functions.parameters import at_least, between_days
from vegaflow.plans import assembled, chain, daily, surface
from vegaflow.plans.registry import SQL, query
from vegaflow.sources.fixtures import BARS_SQL, CONTRACTS_SQL, TERM_SQL, VIX_SQL, contracts, daily_bars, sql_round, table, term_structure, vol_indices

# exposure history

GEX_DAYS_SQL = f"""{BARS_SQL}, gex_days AS (
  SELECT CAST(o_orderdate AS DATE) AS trading_date, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS DOUBLE) AS call_gex, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS DOUBLE) AS put_gex,
    count(*) FILTER (l_returnflag <> 'N') AS atm_contract_count, count(*) AS contract_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""


def gex_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily exposure from line items: flags A and R are calls and puts, quantities their exposure."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    flag = F.col("l_returnflag")
    amount = lambda f: F.sum(F.when(flag == f, F.col("l_quantity")).otherwise(0)).cast("double")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.to_date("o_orderdate").alias("trading_date")).agg(amount("A").alias("call_gex"), amount("R").alias("put_gex"), F.count_if(flag != "N").alias("atm_contract_count"), F.count("*").alias("contract_count"))


@query(f"""WITH {GEX_DAYS_SQL}, r AS (SELECT *, ln(close / lag(close) OVER (ORDER BY trading_date)) AS x FROM bars), v AS (SELECT *, count(x) OVER w AS n, var_samp(x) OVER w AS var FROM r WINDOW w AS (ORDER BY trading_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
j AS (SELECT v.trading_date, close, CASE WHEN day(v.trading_date) % 10 <> 0 THEN (high + low) / 2 END AS flip, call_gex, put_gex, atm_contract_count, contract_count, CASE WHEN n = 10 AND var > 0 THEN sqrt(var * 252) END AS hv FROM v JOIN gex_days USING (trading_date))
SELECT trading_date, close AS spx_close, call_gex - put_gex AS net_gex, flip AS vol_flip_strike, CASE WHEN flip IS NOT NULL THEN CASE WHEN close >= flip THEN 'positive' ELSE 'negative' END WHEN call_gex >= put_gex THEN 'positive' ELSE 'negative' END AS regime,
  {sql_round('CASE WHEN call_gex + put_gex > 0 AND atm_contract_count >= 12 THEN (call_gex - put_gex) / (call_gex + put_gex) * 10 WHEN call_gex + put_gex > 0 AND contract_count >= 20 THEN (call_gex - put_gex) / (call_gex + put_gex) * 10 END', 4)} AS gamma_index, {sql_round('hv', 4)} AS hv_10d FROM j""")
def gex_history(spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Exposure, flip, regime, Gamma Index and ten-day realised volatility of each day, of all days or the asked ones.

    Every tenth day of a month has no flip, so that the fallback on the sign of
    the exposure is used. The volatility looks back before the first asked day.
    """
    w = daily.days().rowsBetween(-9, 0)
    r = daily_bars(spark, sf_dir).withColumn("x", F.log(F.col("close") / F.lag("close").over(daily.days())))
    var = F.var_samp("x").over(w)
    v = r.withColumns({"hv": F.when((F.count("x").over(w) == 10) & (var > 0), F.sqrt(var * 252)), "flip": F.when(F.dayofmonth("trading_date") % 10 != 0, (F.col("high") + F.col("low")) / 2)})
    j = v.where(between_days("trading_date", first, last)).join(gex_days(spark, sf_dir), "trading_date")
    net = F.col("call_gex") - F.col("put_gex")
    regime = F.when(F.col("flip").isNotNull(), F.when(F.col("close") >= F.col("flip"), "positive").otherwise("negative")).when(net >= 0, "positive").otherwise("negative")
    index = chain.gamma_index(F.col("call_gex"), F.col("put_gex"), F.col("atm_contract_count"), F.col("call_gex"), F.col("put_gex"), F.col("contract_count"), 12, 20)
    return j.select("trading_date", F.col("close").alias("spx_close"), net.alias("net_gex"), F.col("flip").alias("vol_flip_strike"), regime.alias("regime"), js_round(index, 4).alias("gamma_index"), js_round(F.col("hv"), 4).alias("hv_10d"))


# rank of implied volatility

RANK_DAYS = 252


@query(f"""WITH {daily.VOL_STATS_SQL}, w AS (SELECT trading_date, iv, count(*) OVER f AS n, min(iv) OVER f AS lo, max(iv) OVER f AS hi FROM stats WHERE iv IS NOT NULL WINDOW f AS (ORDER BY trading_date ROWS BETWEEN {RANK_DAYS - 1} PRECEDING AND CURRENT ROW))
SELECT trading_date, {sql_round('iv', 6)} AS iv_30d_cm, {sql_round('CASE WHEN n >= 2 THEN CASE WHEN hi > lo THEN (iv - lo) / (hi - lo) * 100 ELSE 50e0 END END', 1)} AS iv_rank FROM w""")
def iv_rank(spark: SparkSession, sf_dir: str, window: int = RANK_DAYS) -> DataFrame:
    """Where each day's constant-maturity volatility lies between the least and the greatest of the last 252 that are known."""
    f = daily.days().rowsBetween(1 - at_least("window", window, 2), 0)
    w = daily.vol_stats_of(spark, sf_dir).where("iv is not null").withColumns({"n": F.count("*").over(f), "lo": F.min("iv").over(f), "hi": F.max("iv").over(f)})
    return w.select("trading_date", js_round(F.col("iv"), 6).alias("iv_30d_cm"), js_round(rank_between(F.col("iv"), F.col("lo"), F.col("hi"), F.col("n")), 1).alias("iv_rank"))


def rank_between(x: Column, lo: Column, hi: Column, n: Column) -> Column:
    """Percent of the way from lo to hi; 50 where they are equal, null under two values."""
    return F.when(n >= 2, F.when(hi > lo, (x - lo) / (hi - lo) * 100).otherwise(50.0))


# default expiration

#: A run is taken half an hour after the close, so an expiration is that much nearer.
LATE = 30 / 1440


def picked_expirations(m: DataFrame) -> DataFrame:
    """run_id, expiration_date, days (fractional), atm_iv of each run's default expiration.

    The day's own expiration is left out. A third Friday of 21 days or more
    (rounded) comes first, nearest to 30 days; then any third Friday, nearest to
    30; then the first expiration.
    """
    days = F.col("dte") - F.lit(LATE)
    third = F.dayofmonth("expiration_date").between(15, 21) & (F.weekday("expiration_date") == 4)
    tier = F.when(~third, 2).when(F.floor(days + 0.5) >= 21, 0).otherwise(1)
    key = F.struct(tier.alias("tier"), F.when(third, F.abs(days - 30)).otherwise(0.0).alias("off"), F.col("expiration_date"))
    best = m.where(F.col("expiration_date") != F.col("trading_date")).groupBy("run_id").agg(F.min_by(F.struct("expiration_date", days.alias("days"), "atm_iv"), key).alias("p"))
    return best.select("run_id", "p.*")


PICK_SQL = f"""pick AS (SELECT run_id, expiration_date, days, atm_iv FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN NOT third THEN 2 WHEN floor(days + 0.5e0) >= 21 THEN 0 ELSE 1 END, CASE WHEN third THEN abs(days - 30) ELSE 0e0 END, expiration_date) AS r
  FROM (SELECT *, dte - {LATE!r}::DOUBLE AS days, day(expiration_date) BETWEEN 15 AND 21 AND isodow(expiration_date) = 5 AS third FROM metrics WHERE expiration_date <> trading_date)) WHERE r = 1)"""


@query(f"WITH {chain.METRICS_SQL}, {PICK_SQL} SELECT run_id, expiration_date, {sql_round('days', 4)} AS days, {sql_round('atm_iv', 6)} AS atm_iv FROM pick")
def default_expirations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expiration that a run's panel opens with."""
    p = picked_expirations(chain.expiration_metrics_of(contracts(spark, sf_dir)))
    return p.select("run_id", "expiration_date", js_round(F.col("days"), 4).alias("days"), js_round(F.col("atm_iv"), 6).alias("atm_iv"))


# snapshot

AFTER = lambda sql: sql.removeprefix(CONTRACTS_SQL + ", ")
DELTAS = {"spot": "spot", "vol_flip": "vol_flip", "put_wall": "put_wall", "call_wall": "call_wall", "pc_ratio_volume": "pc_volume", "pc_ratio_oi": "pc_oi", "gamma_index": "gi"}
SIGNS = ("put_wall", "vol_flip", "call_wall")


def rank_sql(first: int) -> str:
    """One row: rank of the first known value among the next 252 known ones, from row ``first`` of the last 253 on."""
    return f"""SELECT CASE WHEN count(*) >= 2 THEN CASE WHEN max(iv) > min(iv) THEN (max(iv) FILTER (k = 1) - min(iv)) / (max(iv) - min(iv)) * 100 ELSE 50e0 END END
      FROM (SELECT iv, row_number() OVER (ORDER BY r) AS k FROM lately WHERE r >= {first} AND iv IS NOT NULL) WHERE k <= {RANK_DAYS}"""


@query(f"""WITH {chain.TOTALS_SQL}, {AFTER(chain.FLIP_SQL)}, {AFTER(chain.WALLS_SQL)}, {AFTER(chain.METRICS_SQL)}, {PICK_SQL}, {daily.VOL_STATS_SQL}, {VIX_SQL},
lately AS (SELECT iv, hv, row_number() OVER (ORDER BY trading_date DESC) AS r FROM stats QUALIFY r <= {RANK_DAYS + 1}),
vol AS (SELECT ({rank_sql(1)}) AS ivr, ({rank_sql(2)}) AS ivr0, (SELECT (iv - hv) * 100 FROM lately WHERE iv IS NOT NULL AND hv IS NOT NULL ORDER BY r LIMIT 1) AS vrp, (SELECT (iv - hv) * 100 FROM lately WHERE r >= 2 AND iv IS NOT NULL AND hv IS NOT NULL ORDER BY r LIMIT 1) AS vrp0),
curve AS (SELECT max_by(close, trading_date) FILTER (symbol = 'VIX') AS vix, max_by(close, trading_date) FILTER (symbol = 'VIX3M') AS vix3m, least(max(trading_date) FILTER (symbol = 'VIX'), max(trading_date) FILTER (symbol = 'VIX3M')) AS curve_date FROM vix),
base AS (SELECT t.run_id, t.trading_date, t.spot, put_wall, call_wall, vol_flip, put_volume / CAST(call_volume AS DOUBLE) AS pc_volume, put_oi / CAST(call_oi AS DOUBLE) AS pc_oi, {chain.INDEX_SQL} AS gi, p.expiration_date, p.atm_iv, p.days
  FROM totals t JOIN flip USING (run_id) JOIN walls USING (run_id) LEFT JOIN pick p USING (run_id)),
led AS (SELECT *, lag(run_id) OVER o AS run0, lag(trading_date) OVER o AS date0, {', '.join(f'lag({c}) OVER o AS {c}0' for c in DELTAS.values())} FROM base WINDOW o AS (ORDER BY trading_date)),
full_row AS (SELECT l.*, m.atm_iv AS atm0 FROM led l LEFT JOIN metrics m ON m.run_id = l.run0 AND m.expiration_date = l.expiration_date WHERE l.put_wall IS NOT NULL AND l.call_wall IS NOT NULL AND l.vol_flip IS NOT NULL AND l.atm_iv IS NOT NULL)
SELECT trading_date, CASE WHEN spot > vol_flip THEN 'POSITIVE' ELSE 'NEGATIVE' END AS gamma_status, {', '.join(f'{sql_round(x, 2)} AS {n}' for x, n in (('spot', 'spot'), ('spot0', 'prev_close'), ('put_wall', 'put_wall'), ('vol_flip', 'vol_flip'), ('call_wall', 'call_wall'), ('spot - vol_flip', 'distance_from_risk_off'), ('spot * atm_iv * sqrt(days / 365e0)', 'expected_move'), ('atm_iv * 100', 'atm_iv'), ('vrp', 'vrp'), ('pc_volume', 'pc_ratio_volume'), ('pc_oi', 'pc_ratio_oi'), ('gi', 'gamma_index'), ('vix', 'vix'), ('vix3m', 'vix3m'), ('(atm_iv - atm0) * 100', 'd_atm_iv'), ('vrp - vrp0', 'd_vrp')))},
  CAST(date0 AS VARCHAR) AS prev_trading_date, {sql_round('ivr', 1)} AS iv_rank, trading_date AS gamma_index_date, {sql_round('vix3m / vix', 4)} AS term_ratio, curve_date AS term_as_of, {sql_round('ivr - ivr0', 1)} AS d_iv_rank,
  {', '.join(f"{sql_round(f'{c} - {c}0', 2)} AS d_{n}" for n, c in DELTAS.items())},
  CASE WHEN {' OR '.join(f'{c} - {c}0 IS NOT NULL' for c in SIGNS)} THEN CAST({' + '.join(f'coalesce(sign({c} - {c}0), 0)' for c in SIGNS)} AS INTEGER) END AS alignment_score, CAST({' + '.join(f'CASE WHEN {c} - {c}0 IS NULL THEN 0 ELSE 1 END' for c in SIGNS)} AS INTEGER) AS alignment_counted
FROM full_row, vol, curve""")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of every run: levels, default expiration, risk premium and rank, curve, changes from the run before and overnight alignment.

    A run without spot, walls, flip or at-the-money volatility has no snapshot.
    """
    c = contracts(spark, sf_dir)
    t = chain.chain_totals(c)
    m = chain.expiration_metrics_of(c)
    index = chain.gamma_index(*(F.col(x) for x in ("atm_call_gex", "atm_put_gex", "atm_contract_count", "call_gex", "put_gex", "contract_count")))
    base = t.withColumns({"pc_volume": safe_divide(F.col("put_volume"), F.col("call_volume")), "pc_oi": safe_divide(F.col("put_oi"), F.col("call_oi")), "gi": index})
    base = base.join(chain.flips(chain.profile(c)).drop("spot"), "run_id").join(chain.wall_levels(chain.by_strike(c), 0.15).select("run_id", "call_wall", "put_wall"), "run_id").join(picked_expirations(m), "run_id", "left")
    o = Window.orderBy("trading_date")  # one row per run
    led = base.withColumns({"run0": F.lag("run_id").over(o), "date0": F.lag("trading_date").over(o), **{f"{x}0": F.lag(x).over(o) for x in DELTAS.values()}})
    before = m.select(F.col("run_id").alias("run0"), "expiration_date", F.col("atm_iv").alias("atm0"))
    x = led.join(before, ["run0", "expiration_date"], "left").where("put_wall is not null and call_wall is not null and vol_flip is not null and atm_iv is not null")
    lately = daily.vol_stats_of(spark, sf_dir).orderBy(F.desc("trading_date")).limit(RANK_DAYS + 1)
    rows = F.sort_array(F.collect_list(F.struct("trading_date", "iv", "hv")), asc=False)  # at most 253
    vol = lately.agg(rows.alias("all")).select(*(e.alias(n) for n, e in (("ivr", rank_of(F.col("all"))), ("ivr0", rank_of(F.slice("all", 2, RANK_DAYS))), ("vrp", premium(F.col("all"))), ("vrp0", premium(F.slice("all", 2, RANK_DAYS))))))
    last = lambda s, v: F.max_by(F.when(F.col("symbol") == s, F.col(v)), F.when(F.col("symbol") == s, F.col("trading_date")))
    curve = vol_indices(spark, sf_dir).agg(last("VIX", "close").alias("vix"), last("VIX3M", "close").alias("vix3m"), F.least(last("VIX", "trading_date"), last("VIX3M", "trading_date")).alias("curve_date"))
    x = x.join(F.broadcast(vol)).join(F.broadcast(curve))  # one row each
    two = {
        "spot": F.col("spot"), "prev_close": F.col("spot0"), "put_wall": F.col("put_wall"), "vol_flip": F.col("vol_flip"), "call_wall": F.col("call_wall"), "distance_from_risk_off": F.col("spot") - F.col("vol_flip"),
        "expected_move": F.col("spot") * F.col("atm_iv") * F.sqrt(F.col("days") / F.lit(365.0)), "atm_iv": F.col("atm_iv") * 100, "vrp": F.col("vrp"), "pc_ratio_volume": F.col("pc_volume"), "pc_ratio_oi": F.col("pc_oi"), "gamma_index": F.col("gi"),
        "vix": F.col("vix"), "vix3m": F.col("vix3m"), "d_atm_iv": (F.col("atm_iv") - F.col("atm0")) * 100, "d_vrp": F.col("vrp") - F.col("vrp0"), **{f"d_{n}": F.col(s) - F.col(f"{s}0") for n, s in DELTAS.items()},
    }
    moves = [F.col(s) - F.col(f"{s}0") for s in SIGNS]
    score = F.when(F.coalesce(*moves).isNotNull(), sum((F.coalesce(F.signum(d), F.lit(0.0)) for d in moves), F.lit(0.0)).cast("int"))
    return x.select(
        "trading_date", F.when(F.col("spot") > F.col("vol_flip"), "POSITIVE").otherwise("NEGATIVE").alias("gamma_status"), *(js_round(e, 2).alias(n) for n, e in two.items()),
        F.col("date0").cast("string").alias("prev_trading_date"), js_round(F.col("ivr"), 1).alias("iv_rank"), F.col("trading_date").alias("gamma_index_date"), js_round(F.col("vix3m") / F.col("vix"), 4).alias("term_ratio"), F.col("curve_date").alias("term_as_of"), js_round(F.col("ivr") - F.col("ivr0"), 1).alias("d_iv_rank"),
        score.alias("alignment_score"), sum((d.isNotNull().cast("int") for d in moves), F.lit(0)).alias("alignment_counted"),
    )


def rank_of(rows: Column) -> Column:
    """Rank of the newest known volatility of rows (newest first) among at most 252 known ones."""
    known = F.slice(F.filter(F.transform(rows, lambda r: r["iv"]), lambda v: v.isNotNull()), 1, RANK_DAYS)
    return rank_between(F.get(known, 0), F.array_min(known), F.array_max(known), F.size(known))


def premium(rows: Column) -> Column:
    """Implied less realised volatility, in points, of the newest row that has both."""
    both = F.filter(rows, lambda r: r["iv"].isNotNull() & r["hv"].isNotNull())
    return (F.get(both, 0)["iv"] - F.get(both, 0)["hv"]) * 100


# chain payload

BAND_SQL = f"""{TERM_SQL}, last_day AS (SELECT max(trading_date) AS day FROM term),
band AS (SELECT g.dte, quantile_cont(atm_iv, 0.5) AS p50 FROM last_day, (SELECT CAST(unnest(generate_series(0, 280)) AS INTEGER) AS dte) g LEFT JOIN term t ON abs(t.dte - g.dte) <= CASE WHEN g.dte < 7 THEN 1 ELSE 3 END AND t.trading_date BETWEEN day - 365 AND day - 1 GROUP BY g.dte)"""


def whole(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


@query(f"""WITH {chain.FLIP_SQL}, {AFTER(chain.WALLS_SQL)}, {AFTER(chain.METRICS_SQL)}, {BAND_SQL},
e AS (SELECT m.*, dense_rank() OVER (PARTITION BY run_id ORDER BY expiration_date) - 1 AS e, p50 FROM metrics m LEFT JOIN band USING (dte)),
x AS (SELECT run_id, count(*) AS expirations, string_agg(CAST(expiration_date AS VARCHAR), ',' ORDER BY e) AS expiration_dates, string_agg(coalesce({whole('floor(atm_iv * 1e4 + 0.5e0)')}, '-'), ',' ORDER BY e) AS atm_iv_bp, string_agg(coalesce({whole('floor(skew_25d_rr * 1e4 + 0.5e0)')}, '-'), ',' ORDER BY e) AS skew_bp, string_agg(coalesce({whole('floor(p50 * 1e4 + 0.5e0)')}, '-'), ',' ORDER BY e) AS band_p50_bp FROM e GROUP BY 1),
k AS (SELECT c.run_id, count(*) AS contract_count, string_agg({whole('e')}, ',' ORDER BY e, strike, is_call) AS exp, string_agg({whole('strike')}, ',' ORDER BY e, strike, is_call) AS strike, string_agg(CASE WHEN is_call THEN '0' ELSE '1' END, ',' ORDER BY e, strike, is_call) AS type, string_agg({whole('floor(iv * 1e4 + 0.5e0)')}, ',' ORDER BY e, strike, is_call) AS iv_bp, string_agg({whole('open_interest')}, ',' ORDER BY e, strike, is_call) AS oi FROM contracts c JOIN e USING (run_id, expiration_date) GROUP BY 1)
SELECT w.run_id, w.trading_date, w.spot, call_wall, put_wall, abs_gamma_strike, {sql_round('vol_flip', 4)} AS vol_flip, expirations, expiration_dates, atm_iv_bp, skew_bp, band_p50_bp, contract_count, exp, strike, type, iv_bp, oi
FROM walls w JOIN flip USING (run_id) JOIN x USING (run_id) JOIN k USING (run_id)""")
def data_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: levels, expirations with their metrics and the latest median band, and the contracts as parallel columns.

    Columns are comma-separated text in one order; volatilities are in basis
    points, so that the text is the same everywhere. A run is a listing, and so bounded.
    """
    c = contracts(spark, sf_dir)
    t = term_structure(spark, sf_dir)
    day = t.agg(F.max("trading_date").alias("day"))
    near = daily.band_join(t, "dte", F.lit(3), (0, 280), "target").where((F.col("target") >= 7) | (F.abs(F.col("dte") - F.col("target")) <= 1))
    year = near.join(F.broadcast(day), (F.col("trading_date") < F.col("day")) & (F.col("trading_date") >= F.date_sub("day", 365)))
    band = year.groupBy(F.col("target").alias("dte")).agg(F.percentile("atm_iv", F.lit(0.5)).alias("p50"))
    points = lambda x: F.coalesce(js_round(F.col(x) * F.lit(1e4)).cast("long").cast("string"), F.lit("-"))
    m = chain.expiration_metrics_of(c).join(band, "dte", "left").withColumn("e", F.dense_rank().over(Window.partitionBy("run_id").orderBy("expiration_date")) - 1)
    listed = F.array_sort(F.collect_list(F.struct("e", F.col("expiration_date").cast("string").alias("d"), points("atm_iv").alias("a"), points("skew_25d_rr").alias("s"), points("p50").alias("p"))))
    joined = lambda rows, f: F.array_join(F.col(f"{rows}.{f}"), ",")
    x = m.groupBy("run_id").agg(F.count("*").alias("expirations"), listed.alias("r")).select("run_id", "expirations", *(joined("r", f).alias(n) for f, n in (("d", "expiration_dates"), ("a", "atm_iv_bp"), ("s", "skew_bp"), ("p", "band_p50_bp"))))
    text = lambda e: e.cast("long").cast("string")
    cells = F.array_sort(F.collect_list(F.struct("e", "strike", "is_call", text(F.col("e")).alias("x"), text(F.col("strike")).alias("k"), F.when(F.col("is_call"), "0").otherwise("1").alias("t"), points("iv").alias("v"), text(F.col("open_interest")).alias("o"))))
    packed = c.join(m.select("run_id", "expiration_date", "e"), ["run_id", "expiration_date"]).groupBy("run_id").agg(F.count("*").alias("contract_count"), cells.alias("r"))
    packed = packed.select("run_id", "contract_count", *(joined("r", f).alias(n) for f, n in (("x", "exp"), ("k", "strike"), ("t", "type"), ("v", "iv_bp"), ("o", "oi"))))
    levels = chain.wall_levels(chain.by_strike(c), 0.15).join(chain.flips(chain.profile(c)).select("run_id", js_round(F.col("vol_flip"), 4).alias("vol_flip")), "run_id")
    return levels.join(x, "run_id").join(packed, "run_id")


# page states

#: The blocks of a page's state: query, key column (or none), numeric fields, text fields, and how many of its last days count (0: all rows).
BLOCKS: dict[str, tuple[str, str | None, tuple[str, ...], tuple[str, ...], int]] = {
    "levels": ("daily_gex_stats", None, ("spx_close", "net_gex", "vol_flip_strike", "call_wall", "put_wall", "gamma_index"), ("regime",), 1),
    "expirations": ("expiration_metrics", "expiration_date", ("atm_iv", "skew_25d_rr", "contract_count"), (), -1),
    "vrp": ("vrp_summary", None, ("vrp", "prev_vrp", "pct_rank_252d"), (), 0),
    "vix": ("vix_summary", "symbol", ("latest", "prior", "change_pct", "pct_rank_252d"), (), 0),
    "vix_curve": ("vol_of_vol", None, ("ratio", "realised"), ("zone",), 1),
    "recent_5": ("vol_stats", "trading_date", ("hv_20d_yz", "iv_30d_cm"), (), 5),
    "recent_30": ("vol_stats", "trading_date", ("hv_20d_yz", "iv_30d_cm"), (), 30),
    "term": ("daily_term_structure", "dte", ("atm_iv",), (), -1),
    "quadrants": ("rotation_quadrants", "symbol", ("rs_ratio", "rs_momentum"), ("quadrant",), 0),
    "performance": ("performance", "symbol", ("change_1d", "change_1w", "change_1m"), ("breadth",), 0),
    "movers": ("heatmap", "symbol", ("change_pct", "rank_up", "rank_down"), (), 0),
    "reporting": ("earnings_calendar", "ticker", ("rank_of_day",), ("session",), -1),
}
LAST = {"daily_gex_stats": "trading_date", "vol_of_vol": "trading_date", "vol_stats": "trading_date", "daily_term_structure": "trading_date", "expiration_metrics": "run_id", "earnings_calendar": "day"}
PAGES = {
    "/": ("levels", "vrp", "vix"), "/tactical/": ("levels", "expirations", "vrp", "term"), "/vix/": ("vix", "vix_curve", "vrp"), "/seasonality/": ("vrp", "recent_5"), "/earnings/": ("levels", "reporting"), "/scan/": ("levels", "expirations", "vix", "vix_curve"),
    "/rotations/": ("quadrants",), "/stocks/": ("performance",), "/heatmap/": ("movers", "performance"), "/events/": ("vix", "vrp"), "/expiring-gamma/": ("levels", "expirations"), "/discrete/": ("levels", "expirations"), "/garch/": ("vrp", "recent_30"),
    "/jump/": ("levels", "expirations"), "/local/": ("levels", "expirations"), "/regime/": ("vrp", "recent_30"), "/risk/": ("levels", "expirations"), "/rough/": ("vrp", "vix", "vix_curve"),
}


def block_sql(name: str) -> str:
    source, key, numbers, texts, last = BLOCKS[name]
    rows = f"(SELECT * FROM ({SQL[source]}))"
    if last > 0:
        rows = f"(SELECT * FROM {rows} ORDER BY {LAST[source]} DESC LIMIT {last})"
    if last < 0:
        rows = f"(SELECT * FROM {rows} QUALIFY {LAST[source]} = max({LAST[source]}) OVER ())"
    key = f"CAST({key} AS VARCHAR)" if key else "''"
    fields = [f"SELECT '{name}' AS block, {key} AS key, '{f}' AS field, CAST({f} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM b_{name}" for f in numbers]
    fields += [f"SELECT '{name}', {key}, '{f}', CAST(NULL AS DOUBLE), {f} FROM b_{name}" for f in texts]
    return f"b_{name} AS MATERIALIZED {rows}, f_{name} AS ({' UNION ALL '.join(fields)})"


def block_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """block, key, field, value, text: a query's rows on their side."""
    from vegaflow.plans.registry import QUERIES

    source, key, numbers, texts, last = BLOCKS[name]
    rows = QUERIES[source](spark, sf_dir)
    if last > 0:
        rows = rows.orderBy(F.desc(LAST[source])).limit(last)
    if last < 0:
        rows = rows.join(F.broadcast(rows.agg(F.max(LAST[source]).alias("_last"))), F.col(LAST[source]) == F.col("_last"))
    number = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
    text = lambda f: F.struct(F.lit(f).alias("field"), F.lit(None).cast("double").alias("value"), F.col(f).alias("text"))
    fields = F.array(*map(number, numbers), *map(text, texts))
    return rows.select(F.lit(name).alias("block"), (F.col(key).cast("string") if key else F.lit("")).alias("key"), F.inline(fields))


def states_sql() -> str:
    pairs = ", ".join(f"('{p}', '{b}')" for p, blocks in PAGES.items() for b in blocks)
    union = " UNION ALL ".join(f"SELECT * FROM f_{b}" for b in BLOCKS)
    return f"WITH {', '.join(map(block_sql, BLOCKS))}, f AS ({union}), pages(page, block) AS (VALUES {pairs}) SELECT page, f.* FROM pages JOIN f USING (block)"


def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of all eighteen pages: (page, block, key, field, value or text); each block is computed once and dealt to its pages."""
    pages = spark.createDataFrame([(p, b) for p, blocks in PAGES.items() for b in blocks], "page string, block string")
    rows = None
    for name in BLOCKS:
        one = block_rows(spark, sf_dir, name)
        rows = one if rows is None else rows.unionAll(one)
    return rows.join(F.broadcast(pages), "block").select("page", "block", "key", "field", "value", "text")


def page_state_of(spark: SparkSession, sf_dir: str, page: str) -> DataFrame:
    """One page's state; only its blocks are computed."""
    from vegaflow.functions.parameters import one_of

    rows = None
    for name in PAGES[one_of("page", page, PAGES)]:
        one = block_rows(spark, sf_dir, name)
        rows = one if rows is None else rows.unionAll(one)
    return rows


import vegaflow.plans.earnings  # noqa: E402, F401 - its calendar is a block

query(states_sql())(page_states)


# freshness and missing cells

OPEN_SQL = "isodow({t}) < 6 AND hour({t}) * 60 + minute({t}) BETWEEN 570 AND 959"
CLOSED_DAYS = market_holidays(2023, 2025)


@query(f"""WITH {surface.RUNS_SQL}, a AS (SELECT run_id, CASE WHEN run_id % 97 <> 0 THEN captured_at END AS as_of, captured_at + (run_id % 25) * INTERVAL 1 MINUTE AS now FROM runs), t AS (SELECT *, timezone('America/New_York', timezone('UTC', now)) AS et FROM a)
SELECT run_id, CASE WHEN as_of IS NULL THEN 'NO DATA' WHEN NOT ({OPEN_SQL.format(t='et')}) OR CAST(et AS DATE) IN ({', '.join(f"DATE '{d}'" for d in CLOSED_DAYS)}) THEN 'MARKET CLOSED' WHEN epoch_us(now) - epoch_us(as_of) <= 600000000 THEN 'LIVE' ELSE 'STALE' END AS freshness FROM t""")
def run_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fresh a run looks some minutes after it was taken: live within ten minutes of an open session."""
    r = surface.run_log(spark, sf_dir).select("run_id", F.when(F.col("run_id") % 97 != 0, F.col("captured_at")).alias("as_of"), F.timestamp_micros(F.unix_micros("captured_at") + F.col("run_id") % 25 * F.lit(60_000_000)).alias("now"))
    et = F.from_utc_timestamp("now", "America/New_York")
    minute = F.hour(et) * 60 + F.minute(et)
    is_open = (F.weekday(et) < 5) & minute.between(570, 959) & ~F.to_date(et).isin(*CLOSED_DAYS)
    label = F.when(F.col("as_of").isNull(), "NO DATA").when(~is_open, "MARKET CLOSED").when(F.unix_micros("now") - F.unix_micros("as_of") <= 600_000_000, "LIVE").otherwise("STALE")
    return r.select("run_id", label.alias("freshness"))


@query(f"""WITH {BARS_SQL}, b AS (SELECT trading_date, close, lag(close) OVER (ORDER BY trading_date) AS before FROM bars WHERE day(trading_date) % 11 <> 0), t AS (SELECT max(trading_date) - 2 AS today FROM bars), s AS (SELECT CAST(unnest(generate_series(date_trunc('week', min(trading_date)), date_trunc('week', max(trading_date)) + INTERVAL 4 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM bars)
SELECT CAST(date_trunc('week', day) AS DATE) AS week, CAST(isodow(day) AS INTEGER) AS weekday, CASE WHEN day > today THEN 'future' WHEN b.trading_date IS NULL THEN 'holiday' WHEN before IS NULL THEN 'no_data' ELSE 'data' END AS kind, CASE WHEN day <= today THEN {sql_round('(close / before - 1) * 100', 4)} END AS pct
FROM s CROSS JOIN t LEFT JOIN b ON b.trading_date = s.day WHERE isodow(day) < 6""")
def week_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the week by weekday grid and why it is empty: in the future, no earlier close, or closed.

    Days whose number 11 divides count as closed, and the last two days as the future, so that each class occurs.
    """
    bars = daily_bars(spark, sf_dir)
    b = bars.where(F.dayofmonth("trading_date") % 11 != 0).select(F.col("trading_date").alias("day"), "close", F.lag("close").over(daily.days()).alias("before"))
    span = bars.agg(F.min("trading_date").alias("lo"), F.max("trading_date").alias("hi"))
    spine = span.select(F.date_sub("hi", 2).alias("today"), F.explode(F.sequence(F.to_date(F.date_trunc("week", "lo")), F.date_add(F.to_date(F.date_trunc("week", "hi")), 4))).alias("day")).where(F.weekday("day") < 5)
    j = spine.join(b.withColumn("traded", F.lit(True)), "day", "left")
    kind = F.when(F.col("day") > F.col("today"), "future").when(F.col("traded").isNull(), "holiday").when(F.col("before").isNull(), "no_data").otherwise("data")
    return j.select(F.to_date(F.date_trunc("week", "day")).alias("week"), (F.weekday("day") + 1).alias("weekday"), kind.alias("kind"), F.when(F.col("day") <= F.col("today"), js_round((F.col("close") / F.col("before") - 1) * 100, 4)).alias("pct"))
