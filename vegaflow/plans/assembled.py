"""Composites: page states, payloads, phases, weekly rotation, and the remaining row-level queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.numeric import js_round
from vegaflow.functions.text import is_percent, leading_number, option_root, significant
from vegaflow.operators.series import first_seeded_ema
from vegaflow.plans import chain, daily, surface
from vegaflow.plans.registry import query
from vegaflow.session import shared_folder
from vegaflow.sources.fixtures import BARS_SQL, CONTRACTS_SQL, PANEL_SQL, contracts, daily_bars, sql_round, symbol_panel, table
from vegaflow.sources.sinks import append

BENCHMARK = daily.BENCHMARK


def seeded_quadrants(p: DataFrame, smooth: int = 4, slow: int = 63, fast: int = 13) -> DataFrame:
    """Latest ratio and momentum of each symbol against the benchmark with first-value-seeded averages."""
    bench = p.where(F.col("symbol") == BENCHMARK).select("trading_date", F.col("close").alias("b"))
    rs = p.where(F.col("symbol") != BENCHMARK).join(bench, "trading_date").select("symbol", "trading_date", (F.col("close") / F.col("b") * 100).alias("rs"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = first_seeded_ema(g.sort_values("trading_date")["rs"].to_numpy(), smooth)
        ratio = x / first_seeded_ema(x, slow) * 100
        momentum = ratio / first_seeded_ema(ratio, fast) * 100
        return pd.DataFrame([{"symbol": key[0], "rs_ratio": ratio[-1], "rs_momentum": momentum[-1], "n": len(x)}])

    return rs.groupBy("symbol").applyInPandas(run, "symbol string, rs_ratio double, rs_momentum double, n long").where(F.col("n") >= slow + fast)


def first_ema_sql(source: str, value: str, window: int, out: str) -> str:
    a = f"(2e0 / {window + 1})"
    return f"{out} AS (SELECT symbol, i, {value} AS e FROM {source} WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n.{value} * {a} + p.e * (1 - {a}) FROM {out} p JOIN {source} n ON n.symbol = p.symbol AND n.i = p.i + 1)"


@query(f"""WITH RECURSIVE {PANEL_SQL}, rs AS (SELECT a.symbol, a.close / b.close * 100 AS rs, row_number() OVER (PARTITION BY a.symbol ORDER BY a.trading_date) AS i FROM panel a JOIN panel b ON b.symbol = '{BENCHMARK}' AND b.trading_date = a.trading_date WHERE a.symbol <> '{BENCHMARK}'),
{first_ema_sql('rs', 'rs', 4, 'f1')}, {first_ema_sql('f1', 'e', 63, 'f2')}, r AS (SELECT symbol, i, f1.e / f2.e * 100 AS ratio FROM f1 JOIN f2 USING (symbol, i)), {first_ema_sql('r', 'ratio', 13, 'f3')},
l AS (SELECT r.symbol, ratio, ratio / f3.e * 100 AS momentum, i, row_number() OVER (PARTITION BY r.symbol ORDER BY i DESC) AS k FROM r JOIN f3 USING (symbol, i))
SELECT symbol, {sql_round('ratio', 5)} AS rs_ratio, {sql_round('momentum', 5)} AS rs_momentum, CASE WHEN ratio >= 100 AND momentum >= 100 THEN 'leading' WHEN ratio >= 100 THEN 'weakening' WHEN momentum >= 100 THEN 'improving' ELSE 'lagging' END AS quadrant FROM l WHERE k = 1 AND i >= 76""")
def rotation_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrant of each symbol by the averages that start from the first value."""
    q = seeded_quadrants(symbol_panel(spark, sf_dir))
    return q.select("symbol", js_round(F.col("rs_ratio"), 5).alias("rs_ratio"), js_round(F.col("rs_momentum"), 5).alias("rs_momentum"), daily.quadrant(F.col("rs_ratio"), F.col("rs_momentum")).alias("quadrant"))


@query(f"""WITH RECURSIVE {PANEL_SQL}, wk AS (SELECT symbol, CAST(date_trunc('week', trading_date) AS DATE) AS week, max_by(close, trading_date) AS c FROM panel GROUP BY 1, 2),
rs AS (SELECT a.symbol, a.week, a.c / b.c * 100 AS rs, row_number() OVER (PARTITION BY a.symbol ORDER BY a.week) AS i, count(*) OVER (PARTITION BY a.symbol) AS n FROM wk a JOIN wk b ON b.symbol = '{BENCHMARK}' AND b.week = a.week WHERE a.symbol <> '{BENCHMARK}'),
{daily.ema_sql('rs', 'rs', 3, 'e1')}, s1 AS (SELECT symbol, i, e AS rs FROM e1), {daily.ema_sql('s1', 'rs', 26, 'e2')}, s2 AS (SELECT a.symbol, a.i, a.rs / b.e * 100 AS ratio FROM s1 a JOIN e2 b USING (symbol, i)),
{daily.ema_sql('s2', 'ratio', 5, 'e3')}, pts AS (SELECT s2.symbol, rs.week, ratio, ratio / e * 100 AS momentum, row_number() OVER (PARTITION BY s2.symbol ORDER BY s2.i DESC) AS r FROM s2 JOIN e3 USING (symbol, i) JOIN rs USING (symbol, i) WHERE n >= 34)
SELECT symbol, week, {sql_round('ratio', 5)} AS rs_ratio, {sql_round('momentum', 5)} AS rs_momentum, CASE WHEN ratio >= 100 AND momentum >= 100 THEN 'leading' WHEN ratio >= 100 THEN 'weakening' WHEN momentum >= 100 THEN 'improving' ELSE 'lagging' END AS quadrant FROM pts WHERE r <= 10""")
def weekly_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative rotation on the last close of each ISO week (windows 3, 26 and 5), ten points each."""
    week = F.date_trunc("week", "trading_date")
    p = symbol_panel(spark, sf_dir).groupBy("symbol", F.to_date(week).alias("week")).agg(F.max_by("close", "trading_date").alias("c"))
    bench = p.where(F.col("symbol") == BENCHMARK).select("week", F.col("c").alias("b"))
    rs = p.where(F.col("symbol") != BENCHMARK).join(bench, "week").select("symbol", "week", (F.col("c") / F.col("b") * 100).alias("rs"))
    r = daily.relative_rotation(rs, ["symbol"], "week", "rs", 3, 26, 5).where("n >= 34")
    r = r.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("week")))).where("r <= 10")
    return r.select("symbol", "week", js_round(F.col("rs_ratio"), 5).alias("rs_ratio"), js_round(F.col("rs_momentum"), 5).alias("rs_momentum"), daily.quadrant(F.col("rs_ratio"), F.col("rs_momentum")).alias("quadrant"))


@query(f"""WITH {BARS_SQL}, r AS (SELECT trading_date, ln(close / lag(close) OVER (ORDER BY trading_date)) * 100 AS x FROM bars), c AS (SELECT trading_date, x - (SELECT avg(x) FROM r) AS e FROM r WHERE x IS NOT NULL)
SELECT trading_date, {sql_round('avg(e * e) OVER (ORDER BY trading_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 5)} AS realised_proxy FROM c""")
def realised_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared residual of the last five days, fewer at the start."""
    w = daily.days()
    r = daily_bars(spark, sf_dir).select("trading_date", (F.log(F.col("close") / F.lag("close").over(w)) * 100).alias("x")).where("x is not null")
    mean = r.agg(F.avg("x").alias("m"))
    e = r.join(F.broadcast(mean)).withColumn("e", F.col("x") - F.col("m"))
    return e.select("trading_date", js_round(F.avg(F.col("e") * F.col("e")).over(w.rowsBetween(-4, 0)), 5).alias("realised_proxy"))


@query(f"""WITH {BARS_SQL}, s AS (SELECT trading_date, close, lag(trading_date) OVER (ORDER BY trading_date) AS before_date, lag(close) OVER (ORDER BY trading_date) AS before FROM bars)
SELECT trading_date AS at_date, {sql_round('before', 2)} AS level, 'step' AS kind FROM s WHERE before IS NOT NULL AND before <> close UNION ALL SELECT trading_date, {sql_round('close', 2)}, 'point' FROM s""")
def step_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series with the previous level inserted at each change, so that lines become steps."""
    w = daily.days()
    s = daily_bars(spark, sf_dir).select("trading_date", "close", F.lag("close").over(w).alias("before"))
    steps = s.where("before is not null and before <> close").select(F.col("trading_date").alias("at_date"), js_round(F.col("before"), 2).alias("level"), F.lit("step").alias("kind"))
    return steps.unionAll(s.select("trading_date", js_round(F.col("close"), 2), F.lit("point")))


@query(f"""WITH {CONTRACTS_SQL}, d AS (SELECT run_id, strike, sum(open_interest) AS oi FROM contracts GROUP BY ALL), t AS (SELECT *, lag(strike) OVER w AS k0, lag(oi) OVER w AS oi0 FROM d WINDOW w AS (PARTITION BY run_id ORDER BY strike)),
a AS (SELECT run_id, strike, coalesce(0.5e0 * (oi + oi0) * (strike - k0), 0e0) AS area FROM t)
SELECT run_id, strike, {sql_round('sum(area) OVER (PARTITION BY run_id ORDER BY strike) / sum(area) OVER (PARTITION BY run_id)', 6)} AS cdf FROM a""")
def open_interest_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trapezoid integral of open interest over strikes as a distribution."""
    d = contracts(spark, sf_dir).groupBy("run_id", "strike").agg(F.sum("open_interest").alias("oi"))
    w = Window.partitionBy("run_id").orderBy("strike")
    area = F.coalesce((F.col("oi") + F.lag("oi").over(w)) * 0.5 * (F.col("strike") - F.lag("strike").over(w)), F.lit(0.0))
    a = d.withColumn("area", area)
    return a.select("run_id", "strike", js_round(F.sum("area").over(w) / F.sum("area").over(Window.partitionBy("run_id")), 6).alias("cdf"))


TARGETS = (7, 14, 30, 60, 90, 180)


def tenors_sql() -> str:
    steps = ["e AS (SELECT DISTINCT run_id, dte FROM contracts)"]
    for i, t in enumerate(TARGETS):
        taken = "".join(f" AND NOT EXISTS (SELECT 1 FROM p{j} WHERE p{j}.run_id = e.run_id AND p{j}.dte = e.dte)" for j in range(i))
        steps.append(f"p{i} AS (SELECT run_id, {t} AS target, arg_min(dte, abs(dte - {t}) * 1000 + dte) AS dte FROM e WHERE true{taken} GROUP BY 1)")
    return f"WITH {CONTRACTS_SQL}, {', '.join(steps)} {' UNION ALL '.join(f'SELECT * FROM p{i}' for i in range(len(TARGETS)))}"


@query(tenors_sql())
def spaced_tenors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct expirations nearest to log-spaced targets, each taken once, in order of the targets: a fold over the targets, in columns."""
    e = contracts(spark, sf_dir).groupBy("run_id").agg(F.collect_set("dte").alias("listed"))
    none = F.array().cast("array<struct<target:int,dte:int>>")

    def take(acc, target):
        pick = F.array_min(F.transform(acc["left"], lambda d: F.struct(F.abs(d - target).alias("off"), d.alias("dte"))))["dte"]
        taken = F.when(pick.isNull(), acc["picks"]).otherwise(F.concat(acc["picks"], F.array(F.struct(target.alias("target"), pick.alias("dte")))))
        return F.struct(F.when(pick.isNull(), acc["left"]).otherwise(F.array_remove(acc["left"], pick)).alias("left"), taken.alias("picks"))

    picks = F.aggregate(F.array(*map(F.lit, TARGETS)), F.struct(F.col("listed").alias("left"), none.alias("picks")), take, lambda acc: acc["picks"])
    return e.select("run_id", F.inline(picks))


@query("""WITH p AS (SELECT p_partkey, 'O:' || CASE p_partkey % 4 WHEN 0 THEN 'SPXW' WHEN 1 THEN 'SPX' WHEN 2 THEN 'AAPL' ELSE 'T' END || '240119C0' || CAST(p_partkey AS VARCHAR) AS sym, CASE WHEN p_partkey % 3 = 0 THEN '1,2' || CAST(p_partkey % 10 AS VARCHAR) || '0.5%' WHEN p_partkey % 3 = 1 THEN 'about -3.5 pts' ELSE 'none' END AS txt, CAST(p_retailprice AS DOUBLE) AS price FROM part)
SELECT p_partkey, CASE WHEN starts_with(sym, 'O:SPXW') THEN 'SPXW' WHEN starts_with(sym, 'O:SPX') THEN 'SPX' ELSE nullif(regexp_extract(sym, '^(?:O:)?([A-Z]+)[0-9]', 1), '') END AS root,
  coalesce(try_cast(nullif(regexp_extract(replace(txt, ',', ''), '[-+]?[0-9]*\\.?[0-9]+'), '') AS DOUBLE), -1e0) AS number, contains(txt, '%') AS is_percent,
  floor(price * pow(1e1, 2 - floor(log10(abs(price)))) + 0.5e0) / pow(1e1, 2 - floor(log10(abs(price)))) AS three_digits FROM p""")
def parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option roots, numbers in text, percent signs and significant digits."""
    k = F.col("p_partkey")
    root = F.when(k % 4 == 0, "SPXW").when(k % 4 == 1, "SPX").when(k % 4 == 2, "AAPL").otherwise("T")
    text = F.when(k % 3 == 0, F.concat(F.lit("1,2"), (k % 10).cast("string"), F.lit("0.5%"))).when(k % 3 == 1, "about -3.5 pts").otherwise("none")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("O:"), root, F.lit("240119C0"), k.cast("string")).alias("sym"), text.alias("txt"), F.col("p_retailprice").cast("double").alias("price"))
    return p.select("p_partkey", option_root(F.col("sym")).alias("root"), F.coalesce(leading_number(F.col("txt")), F.lit(-1.0)).alias("number"), is_percent(F.col("txt")).alias("is_percent"), significant(F.col("price"), 3).alias("three_digits"))


@query("""SELECT date_trunc('minute', ts) AS minute, count(*) AS n, count(DISTINCT user_id) AS users, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1 HAVING count(*) >= 2""")
def minute_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes with several events."""
    g = table(spark, sf_dir, "events").groupBy(F.date_trunc("minute", "ts").alias("minute"))
    return g.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")).where("n >= 2")


#: The end-of-day phases in dependency order.
PHASES = {"term_structure": daily.daily_term_structure, "gex_stats": chain.daily_gex_stats, "cloud_bands": daily.cloud_bands_history, "vol_stats": daily.vol_stats, "vix_family": daily.vix_summary, "symbols": daily.performance, "intraday_bars": daily.intraday_seasonality, "reconciliation": surface.reconciliation}


@query()
def end_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the phases in order, each into a table of the shared folder; a failing phase is reported and does not stop the others."""
    root, out = shared_folder(spark, "end-of-day"), []
    for name, phase in PHASES.items():
        try:
            append(phase(spark, sf_dir), f"{root}/{name}")
            out.append((name, "success", spark.read.parquet(f"{root}/{name}").count(), None))
        except Exception as e:  # noqa: BLE001 - the report is the result
            out.append((name, "error", None, str(e)[:200]))
    return spark.createDataFrame(out, "phase string, status string, n_rows bigint, message string")


@query()
def page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landing page's state in one row: latest levels, flip regime, volatility summary, breadth and quadrants."""
    last = chain.daily_gex_stats(spark, sf_dir).orderBy(F.desc("trading_date")).limit(1)
    vix = daily.vix_summary(spark, sf_dir).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", F.struct("latest", "change_pct", "pct_rank_252d"))))).alias("indices"))
    breadth = daily.performance(spark, sf_dir).agg(F.count_if(F.col("breadth") == "up").alias("up"), F.count_if(F.col("breadth") == "down").alias("down"), F.count_if(F.col("breadth") == "flat").alias("flat"))
    quadrants = rotation_quadrants(spark, sf_dir).groupBy().agg(*(F.count_if(F.col("quadrant") == q).alias(q) for q in ("leading", "weakening", "improving", "lagging")))
    vrp = daily.vrp_summary(spark, sf_dir).select("vrp", "prev_vrp", F.col("pct_rank_252d").alias("vrp_rank"))
    out = last
    for part in (vix, breadth, quadrants, vrp):  # each is one row
        out = out.join(F.broadcast(part))
    return out


@query()
def chain_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: levels, per-expiration metrics and the contracts as parallel arrays."""
    c = contracts(spark, sf_dir)
    levels = surface.wall_levels(chain.by_strike(c), 0.15).drop("trading_date", "spot")
    metrics = chain.expiration_metrics_of(c).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("expiration_date", "dte", "atm_iv", "skew_25d_rr", "contract_count"))).alias("expirations"))
    e = c.select("run_id", "expiration_date").distinct().withColumn("e", F.dense_rank().over(Window.partitionBy("run_id").orderBy("expiration_date")) - 1)
    rows = F.array_sort(F.collect_list(F.struct("e", "strike", (~F.col("is_call")).cast("int").alias("type"), js_round(F.col("iv"), 4).alias("iv"), "open_interest")))
    packed = c.join(e, ["run_id", "expiration_date"]).groupBy("run_id", "trading_date", "spot").agg(rows.alias("r"))
    packed = packed.select("run_id", "trading_date", "spot", F.struct(*(F.col(f"r.{n}").alias(n) for n in ("e", "strike", "type", "iv", "open_interest"))).alias("contracts"))
    return packed.join(levels, "run_id").join(metrics, "run_id")
