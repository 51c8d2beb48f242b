"""Record keeping: upserts, conditional updates, retention, rosters and set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.numeric import js_round, to_number
from vegaflow.functions.text import LANES
from vegaflow.operators.series import latest_per_key, upserted
from vegaflow.plans.registry import query
from vegaflow.plans.surface import RUNS_SQL, run_log
from vegaflow.sources.fixtures import BARS_SQL, CONTRACTS_SQL, TERM_SQL, contracts, daily_bars, sql_round, table, term_structure
from vegaflow.sources.landing import SEED_RANGES, seeded


@query(f"""WITH {BARS_SQL}, {TERM_SQL}, n AS (SELECT trading_date, avg(atm_iv) AS close, CAST(count(*) AS BIGINT) AS sample_count FROM term WHERE dte < 30 GROUP BY 1)
SELECT trading_date, b.open, b.high, b.low, {sql_round('coalesce(n.close, b.close)', 6)} AS close, sample_count FROM bars b FULL JOIN n USING (trading_date)""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two phases that write different columns of one row: supplied values win, the rest stays."""
    new = term_structure(spark, sf_dir).where("dte < 30").groupBy("trading_date").agg(F.avg("atm_iv").alias("close"), F.count("*").alias("sample_count"))
    return upserted(daily_bars(spark, sf_dir), new, ["trading_date"]).withColumn("close", js_round(F.col("close"), 6))


@query("""WITH v AS (SELECT s_suppkey, s_acctbal + 1 AS bal FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 3 = 1)
SELECT s.s_suppkey, floor(v.bal * 1e2 + 0.5e0) / 1e2 AS s_acctbal FROM supplier s JOIN v USING (s_suppkey) WHERE s.s_acctbal IS DISTINCT FROM v.bal""")
def changed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an idempotent update really changes (null-safe difference)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    v = s.where("s_suppkey % 3 = 0").withColumn("bal", F.col("s_acctbal") + 1).unionByName(s.where("s_suppkey % 3 = 1").withColumn("bal", F.col("s_acctbal"))).drop("s_acctbal")
    return s.join(v, "s_suppkey").where(~F.col("s_acctbal").eqNullSafe(F.col("bal"))).select("s_suppkey", js_round(F.col("bal"), 2).alias("s_acctbal"))


@query(f"""WITH {RUNS_SQL}, t AS (SELECT max(trading_date) AS today FROM runs) SELECT trading_date, status, count(*) AS kept FROM runs, t
WHERE NOT (status = 'partial' AND trading_date < today - 7) AND NOT (status = 'success' AND trading_date < today - 20) GROUP BY 1, 2""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retention pass keeps: partial runs for 7 days, successful ones for 20."""
    r = run_log(spark, sf_dir)
    today = r.agg(F.max("trading_date").alias("today"))
    old = F.datediff("today", "trading_date") > F.when(F.col("status") == "partial", 7).otherwise(20)
    return r.join(F.broadcast(today)).where(~old).groupBy("trading_date", "status").agg(F.count("*").alias("kept"))


@query(f"WITH {RUNS_SQL} SELECT trading_date, max(captured_at) AS captured_at, max_by(run_id, captured_at) AS run_id, {sql_round('max_by(spot, captured_at)', 6)} AS spot FROM runs WHERE status = 'success' GROUP BY 1")
def latest_healthy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest successful run of each day."""
    r = run_log(spark, sf_dir).where("status = 'success'").drop("has_atm", "status")
    return latest_per_key(r, ["trading_date"], ["captured_at"]).select("trading_date", "captured_at", "run_id", js_round(F.col("spot"), 6).alias("spot"))


@query("""WITH v AS (SELECT p_brand AS symbol, sum(l_quantity) AS volume, sum(l_extendedprice) AS cap FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY volume DESC, symbol) AS ov_rank, row_number() OVER (ORDER BY round(cap, 2) DESC, symbol) AS mc_rank FROM v)
SELECT symbol, CAST(volume AS BIGINT) AS volume, ov_rank, mc_rank, ov_rank - mc_rank AS hype, floor(2e0 / (1e0 / ov_rank + 1e0 / mc_rank) * 1e6 + 0.5e0) / 1e6 AS score, row_number() OVER (ORDER BY 2e0 / (1e0 / ov_rank + 1e0 / mc_rank), symbol) <= 10 AS anchor FROM r""")
def volume_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols ranked by volume and by size, the gap of the ranks, and the ten anchors by harmonic mean rank."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    v = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("symbol")).agg(F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("cap"))
    r = v.withColumns({"ov_rank": F.row_number().over(Window.orderBy(F.desc("volume"), "symbol")), "mc_rank": F.row_number().over(Window.orderBy(F.desc(F.round("cap", 2)), "symbol"))})
    score = F.lit(2.0) / (F.lit(1.0) / F.col("ov_rank") + F.lit(1.0) / F.col("mc_rank"))
    return r.select("symbol", F.col("volume").cast("long").alias("volume"), "ov_rank", "mc_rank", (F.col("ov_rank") - F.col("mc_rank")).alias("hype"), js_round(score, 6).alias("score"), (F.row_number().over(Window.orderBy(score, "symbol")) <= 10).alias("anchor"))


@query("""SELECT 'only_orders' AS side, count(*) AS n FROM (SELECT DISTINCT o_orderkey AS k FROM orders EXCEPT SELECT DISTINCT l_orderkey FROM lineitem)
UNION ALL SELECT 'only_lines', count(*) FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem EXCEPT SELECT DISTINCT o_orderkey FROM orders)
UNION ALL SELECT 'both', count(*) FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem INTERSECT SELECT DISTINCT o_orderkey FROM orders)""")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences and intersection of two key sets."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    parts = {"only_orders": o.subtract(li), "only_lines": li.subtract(o), "both": li.intersect(o)}
    out = None
    for side, d in parts.items():
        row = d.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
        out = row if out is None else out.unionAll(row)
    return out


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN value >= 0 THEN ln(1 + value) ELSE -ln(1 - value) END IS NOT NULL AS has_value, floor((sign(value) * ln(1 + abs(value))) * 1e6 + 0.5e0) / 1e6 AS symlog,
  CASE WHEN abs(value) >= 100 THEN 'high' WHEN abs(value) >= 10 THEN 'mid' ELSE 'low' END AS size_class FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value IS NOT NULL""")
def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON fields as numbers with non-finite ones as null, a symmetric logarithm and a size class."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase") & F.col("value").isNotNull())
    v = F.abs("value")
    return e.select("event_id", to_number(F.get_json_object("props", "$.k")).alias("k"), F.col("value").isNotNull().alias("has_value"), js_round(F.signum("value") * F.log1p(v), 6).alias("symlog"), F.when(v >= 100, "high").when(v >= 10, "mid").otherwise("low").alias("size_class"))


@query("""SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS trading_date FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)""")
def non_empty_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that have any row of a kind: one hit is enough, so a semi-join stops there."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select(F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("trading_date"))


@query(f"""WITH {CONTRACTS_SQL} SELECT run_id, count(*) AS listed, count(*) FILTER (gamma IS NOT NULL AND delta IS NOT NULL AND iv > 0.001e0 AND (dte <= 30 OR (day(expiration_date) BETWEEN 15 AND 21 AND isodow(expiration_date) = 5))) AS eligible, count(DISTINCT expiration_date) FILTER (dte > 30 AND day(expiration_date) BETWEEN 15 AND 21 AND isodow(expiration_date) = 5) AS monthly_targets FROM contracts GROUP BY 1""")
def eligible_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts that an ingest keeps: with greeks and volatility, and within 30 days or of a monthly expiration."""
    third = F.dayofmonth("expiration_date").between(15, 21) & (F.weekday("expiration_date") == 4)
    sound = F.col("gamma").isNotNull() & F.col("delta").isNotNull() & (F.col("iv") > 0.001)
    c = contracts(spark, sf_dir)
    return c.groupBy("run_id").agg(F.count("*").alias("listed"), F.count_if(sound & ((F.col("dte") <= 30) | third)).alias("eligible"), F.countDistinct(F.when((F.col("dte") > 30) & third, F.col("expiration_date"))).alias("monthly_targets"))


def lane_sql(start: int, factor: int, times: int) -> str:
    x = f"xor(h, k * {times}::BIGINT)"
    step = f"(({x} >> 16) * {factor}::BIGINT % 65536 * 65536 + ({x} & 65535) * {factor}::BIGINT) % 4294967296"
    return f"list_reduce(list_transform(string_split(symbol, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, k: {step}, {start}::BIGINT)"


@query(f"""WITH s AS (SELECT DISTINCT p_brand AS symbol FROM part), h AS (SELECT symbol, {', '.join(f'{lane_sql(*how)} AS {n}' for n, *how in LANES)} FROM s),
v AS (SELECT symbol, {', '.join(f'{low!r}::DOUBLE + {lane} / 4294967295e0 * {width!r}::DOUBLE AS {name}' for name, lane, low, width in SEED_RANGES)} FROM h), c AS (SELECT count(*) FILTER (length(symbol) = 7) * 1e0 / count(*) AS covered FROM s)
SELECT symbol, CASE WHEN covered < 0.5e0 THEN 'seed' ELSE 'live' END AS mode, {sql_round('atm_iv', 6)} AS atm_iv, {sql_round('atm_iv + call_skew', 6)} AS call_25d_iv, {sql_round('atm_iv + put_skew', 6)} AS put_25d_iv, {sql_round('put_skew - call_skew', 6)} AS rr_skew FROM v, c""")
def seed_skews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in skews of all symbols where under half of them have live data (here: those with a name of seven letters)."""
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    covered = s.agg((F.count_if(F.length("symbol") == 7) / F.count("*")).alias("covered"))
    v = seeded(s).drop("mode").join(F.broadcast(covered))  # one row
    put, call = F.col("put_skew"), F.col("call_skew")
    return v.select("symbol", F.when(F.col("covered") < 0.5, "seed").otherwise("live").alias("mode"), js_round(F.col("atm_iv"), 6).alias("atm_iv"), js_round(F.col("atm_iv") + call, 6).alias("call_25d_iv"), js_round(F.col("atm_iv") + put, 6).alias("put_25d_iv"), js_round(put - call, 6).alias("rr_skew"))
