"""Adapters: market-shaped tables from the star-schema tables, as DataFrames.

``*_SQL`` hold the same definitions as common table expressions for the oracle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vegaflow.functions.numeric import bs_delta, bs_gamma

D = "double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: a quote of an option chain snapshot, repeats included."""
    li = table(spark, sf_dir, "lineitem")
    strike = (F.lit(4000) + F.lit(25) * (F.col("l_partkey") % 81)).cast(D)
    dte = ((F.col("l_suppkey") % 12) * 15 + 3).cast("int")
    return li.select(
        F.col("l_linenumber").cast("int").alias("run_id"),
        F.date_add(F.lit("2002-01-07").cast("date"), F.col("l_linenumber").cast("int")).alias("trading_date"),
        (F.lit(5000.0) + F.lit(25.0) * (F.col("l_linenumber") - 4)).alias("spot"),
        dte.alias("dte"),
        F.when((F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "N") & (F.col("l_orderkey") % 2 == 0)), "call").otherwise("put").alias("contract_type"),
        strike.alias("strike"),
        (F.lit(0.1) + F.lit(2.0) * F.col("l_discount") + F.abs(strike - 5000) / F.lit(20000.0)).alias("iv"),
        (F.col("l_quantity") * 10).cast("long").alias("open_interest"),
        F.floor(F.col("l_extendedprice") / 100).cast("long").alias("volume"),
        "l_orderkey",
        "l_extendedprice",
        "l_suppkey",
    )


RAW_SQL = """raw_chain AS (
  SELECT CAST(l_linenumber AS INTEGER) AS run_id, DATE '2002-01-07' + CAST(l_linenumber AS INTEGER) AS trading_date,
    CAST(5000 + 25 * (l_linenumber - 4) AS DOUBLE) AS spot, CAST((l_suppkey % 12) * 15 + 3 AS INTEGER) AS dte,
    CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_orderkey % 2 = 0) THEN 'call' ELSE 'put' END AS contract_type,
    CAST(4000 + 25 * (l_partkey % 81) AS DOUBLE) AS strike,
    1e-1 + 2e0 * l_discount + abs(CAST(4000 + 25 * (l_partkey % 81) AS DOUBLE) - 5000) / 2e4 AS iv,
    CAST(l_quantity * 10 AS BIGINT) AS open_interest, CAST(floor(l_extendedprice / 100) AS BIGINT) AS volume,
    l_orderkey, l_extendedprice, l_suppkey
  FROM lineitem)"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contract of a run: repeats are added up; greeks by closed form."""
    c = raw_chain(spark, sf_dir).groupBy("run_id", "trading_date", "spot", "dte", "contract_type", "strike").agg(
        F.max("iv").alias("iv"), F.sum("open_interest").alias("open_interest"), F.sum("volume").alias("volume")
    )
    t = F.col("dte").cast(D) / F.lit(365.25)
    is_call = F.col("contract_type") == "call"
    return c.withColumns(
        {
            "tau": t,
            "gamma": bs_gamma(F.col("spot"), F.col("strike"), t, F.col("iv")),
            "delta": bs_delta(F.col("spot"), F.col("strike"), t, F.col("iv"), is_call),
            "expiration_date": F.date_add("trading_date", F.col("dte")),
            "is_call": is_call,
        }
    )


def sql_pdf(x: str) -> str:
    return f"(0.3989422804014327e0 * exp(-0.5e0 * ({x}) * ({x})))"


def sql_cdf(x: str) -> str:
    k = f"(1e0 / (1e0 + 0.2316419e0 * abs({x})))"
    poly = f"({k} * (0.319381530e0 + {k} * (-0.356563782e0 + {k} * (1.781477937e0 + {k} * (-1.821255978e0 + {k} * 1.330274429e0)))))"
    return f"(CASE WHEN ({x}) >= 0 THEN 1e0 - {sql_pdf(x)} * {poly} ELSE {sql_pdf(x)} * {poly} END)"


def sql_round(x: str, n: int) -> str:
    return f"(floor(({x}) * 1e{n} + 0.5e0) / 1e{n})"


CONTRACTS_SQL = f"""{RAW_SQL}, summed AS (
  SELECT run_id, trading_date, spot, dte, contract_type, strike, max(iv) AS iv,
    CAST(sum(open_interest) AS BIGINT) AS open_interest, CAST(sum(volume) AS BIGINT) AS volume
  FROM raw_chain GROUP BY ALL
), with_d1 AS (
  SELECT *, dte / 365.25e0 AS tau, (ln(spot / strike) + (0.045e0 + 0.5e0 * iv * iv) * (dte / 365.25e0)) / (iv * sqrt(dte / 365.25e0)) AS d1 FROM summed
), contracts AS (
  SELECT *, {sql_pdf("d1")} / (spot * iv * sqrt(tau)) AS gamma,
    {sql_cdf("d1")} - CASE WHEN contract_type = 'call' THEN 0e0 ELSE 1e0 END AS delta,
    trading_date + dte AS expiration_date, contract_type = 'call' AS is_call
  FROM with_d1)"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trading_date, open, high, low, close from orders by day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("trading_date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close")
    )


BARS_SQL = """bars AS (
  SELECT CAST(o_orderdate AS DATE) AS trading_date, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1)"""


def term_structure(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """trading_date, dte (0..280), atm_iv; of the days of ``orders`` only, if given."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders") if orders is None else orders
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.to_date("o_orderdate").alias("trading_date"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 281).cast("int").alias("dte"))
        .agg(F.max(F.lit(0.1) + F.col("l_discount") + F.col("l_tax")).alias("atm_iv"))
    )


TERM_SQL = """term AS (
  SELECT CAST(o_orderdate AS DATE) AS trading_date, CAST((l_partkey * 7 + l_linenumber) % 281 AS INTEGER) AS dte,
    max(1e-1 + l_discount + l_tax) AS atm_iv
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def orders_of(spark: SparkSession, sf_dir: str, days: Sequence[date], path: str) -> DataFrame:
    """o_orderkey, o_orderdate of the days. Written to ``path``, so that Spark plans joins by their true size: beside those of a few days, no line item is shuffled."""
    o = table(spark, sf_dir, "orders").where(F.to_date("o_orderdate").isin(list(days)))
    o.select("o_orderkey", "o_orderdate").write.parquet(path)
    return spark.read.parquet(path)


def symbol_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trading_date, close: brands by ship day, one with a split in 1999."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    day = F.to_date("l_shipdate")
    return (
        li.join(p.select("p_partkey", "p_brand"), li.l_partkey == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("symbol"), day.alias("trading_date"))
        .agg(F.sum("l_quantity").alias("q"))
        .select("symbol", "trading_date", ((F.lit(100.0) + F.col("q") / F.lit(10.0)) * F.when((F.col("symbol") == "Brand#1") & (F.col("trading_date") >= F.lit("1999-01-01").cast("date")), 0.5).otherwise(1.0)).alias("close"))
    )


PANEL_SQL = """panel AS (
  SELECT symbol, trading_date, (1e2 + q / 1e1) * CASE WHEN symbol = 'Brand#1' AND trading_date >= DATE '1999-01-01' THEN 0.5e0 ELSE 1e0 END AS close
  FROM (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS trading_date, sum(l_quantity) AS q
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""

#: Market segments stand for volatility indices.
INDEX_OF = {"BUILDING": "VIX", "MACHINERY": "VIX3M", "AUTOMOBILE": "VVIX", "FURNITURE": "SDEX", "HOUSEHOLD": "TDEX"}


def vol_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trading_date, close (two decimals): volatility indices by order day."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    names = F.create_map(*(F.lit(x) for kv in INDEX_OF.items() for x in kv))
    day = F.to_date("o_orderdate").alias("trading_date")
    joined = o.join(c.select("c_custkey", "c_mktsegment"), o.o_custkey == F.col("c_custkey"))
    cents = F.sum(F.floor(F.col("o_totalprice") * F.lit(100.0) + F.lit(0.5)))
    return joined.groupBy(names[F.col("c_mktsegment")].alias("symbol"), day).agg((F.floor(cents / F.count("*") / F.lit(20000.0) + F.lit(1000.5)) / F.lit(100.0)).alias("close")).where("symbol is not null")


VIX_SQL = f"""vix AS (
  SELECT CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in INDEX_OF.items())} END AS symbol, CAST(o_orderdate AS DATE) AS trading_date,
    floor(sum(CAST(floor(o_totalprice * 1e2 + 0.5e0) AS BIGINT)) / count(*) / 2e4 + 1000.5e0) / 1e2 AS close
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING symbol IS NOT NULL)"""


def half_hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket (start, UTC-5 wall clock), open, high, low, close, n from events."""
    e = events(spark, sf_dir).withColumn("wall", F.col("ts") - F.expr("INTERVAL 5 HOURS"))
    bucket = F.window("wall", "30 minutes")["start"]
    return e.groupBy(bucket.alias("bucket")).agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("n"))


BARS30_SQL = """bars30 AS (
  SELECT time_bucket(INTERVAL 30 MINUTE, ts - INTERVAL 5 HOUR) AS bucket, min_by(value, event_id) AS open, max(value) AS high,
    min(value) AS low, max_by(value, event_id) AS close, count(*) AS n FROM events GROUP BY 1)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts as an instant (the session is in UTC)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


#: First day of the earnings feed and how many weekdays of it a calendar shows.
FEED_START, FEED_DAYS = "2024-01-02", 20


def earnings_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, place (order within the feed), ticker (as sent, lower case), company, release_time, q1_rev, q_sales: customers as reporting names."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.date_add(F.lit(FEED_START).cast("date"), (k % 28).cast("int")).alias("day"),
        k.alias("place"),
        F.concat(F.lit("brand#"), (k % 32).cast("string")).alias("ticker"),
        F.col("c_name").alias("company"),
        (k % 4).cast("int").alias("release_time"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, 0.0).otherwise(F.col("c_acctbal") * F.lit(1e6)).alias("q1_rev"),
        F.when(k % 7 != 0, F.col("c_acctbal") * 2).alias("q_sales"),
    )


FEED_SQL = f"""feed AS (
  SELECT DATE '{FEED_START}' + CAST(c_custkey % 28 AS INTEGER) AS day, c_custkey AS place, 'brand#' || CAST(c_custkey % 32 AS VARCHAR) AS ticker, c_name AS company, CAST(c_custkey % 4 AS INTEGER) AS release_time,
    CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 0e0 ELSE c_acctbal * 1e6 END AS q1_rev, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal * 2 END AS q_sales FROM customer)"""

#: Titles that a macro calendar may carry, dealt to events by id.
TITLES = ("US Federal Funds Rate", "Core CPI m/m", "Non-Farm Employment Change", "Advance GDP q/q", "Core PCE Price Index m/m", "PPI m/m", "ISM Manufacturing PMI", "US Unemployment Claims", "UK Bank Holiday", "German Ifo Business Climate", "FOMC Statement", "Trade Balance")


def macro_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, title, impact (as sent, lower case; some null)."""
    k = F.col("event_id")
    impact = F.element_at(F.array(*(F.lit(x) for x in ("high", "medium", "LOW", "holiday", "non-economic", None))), (k % 6 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", "ts", F.element_at(F.array(*map(F.lit, TITLES)), (k % len(TITLES) + 1).cast("int")).alias("title"), impact.alias("impact"))


MACRO_SQL = f"""macro AS (SELECT event_id, ts, [{', '.join(f"'{t}'" for t in TITLES)}][event_id % {len(TITLES)} + 1] AS title, ['high', 'medium', 'LOW', 'holiday', 'non-economic', NULL][event_id % 6 + 1] AS impact FROM events)"""
