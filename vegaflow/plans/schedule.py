"""Calendars of events: trading days, expirations, event lists and their nearest expirations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.calendar import holidays_df, market_holidays, third_friday
from vegaflow.functions.numeric import js_round
from vegaflow.operators.series import first_on_or_after
from vegaflow.plans.chain import METRICS_SQL, expiration_metrics_of
from vegaflow.plans.registry import query
from vegaflow.sources.fixtures import MACRO_SQL, contracts, events, macro_events, sql_round, table

HOLIDAYS_SQL = "(SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in market_holidays(2023, 2025)) + "]) AS holiday)"
#: Years whose market holidays the calendars know; orders outside of them are the caller's to add.
FIRST_YEAR, LAST_YEAR = 1990, 2030
CLOSED_SQL = "(SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in market_holidays(FIRST_YEAR, LAST_YEAR)) + "]) AS holiday)"
SPAN_SQL = "span AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders)"


def order_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lo, hi: first and last day of the orders."""
    return table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))


@query(f"""WITH {SPAN_SQL}, d AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS trading_date FROM span), t AS (SELECT * FROM d WHERE isodow(trading_date) < 6 AND trading_date NOT IN (SELECT holiday FROM {CLOSED_SQL})),
n AS (SELECT CAST(o_orderdate AS DATE) AS trading_date, count(*) AS orders FROM orders GROUP BY 1)
SELECT t.trading_date, lag(t.trading_date) OVER (ORDER BY t.trading_date) AS previous_day, CAST(row_number() OVER (PARTITION BY date_trunc('month', t.trading_date) ORDER BY t.trading_date) AS INTEGER) AS day_of_month, coalesce(orders, 0) AS orders FROM t LEFT JOIN n USING (trading_date) QUALIFY previous_day IS NOT NULL""")
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days in the span of the orders with the one before, their number within the month, and the orders of each."""
    d = order_span(spark, sf_dir).select(F.explode(F.sequence("lo", "hi")).alias("trading_date")).where(F.weekday("trading_date") < 5)
    t = d.join(F.broadcast(holidays_df(spark, FIRST_YEAR, LAST_YEAR)), F.col("trading_date") == F.col("holiday"), "left_anti")
    n = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("trading_date")).agg(F.count("*").alias("orders"))
    t = t.join(n, "trading_date", "left")
    # a calendar: as many rows as there are days
    return t.select("trading_date", F.lag("trading_date").over(Window.orderBy("trading_date")).alias("previous_day"), F.row_number().over(Window.partitionBy(F.trunc("trading_date", "month")).orderBy("trading_date")).alias("day_of_month"), F.coalesce("orders", F.lit(0)).alias("orders")).where("previous_day is not null")


@query(f"""WITH {SPAN_SQL}, m AS (SELECT CAST(unnest(generate_series(date_trunc('month', CAST(lo AS TIMESTAMP)), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM span), f AS (SELECT m, m + CAST((12 - isodow(m)) % 7 AS INTEGER) + 14 AS third FROM m)
SELECT m AS month, third AS third_friday, CASE WHEN third IN (SELECT holiday FROM {CLOSED_SQL}) THEN third - 1 ELSE third END AS expiration FROM f""")
def monthly_expirations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third Fridays of the months that the orders span, rolled back a day where the market is closed."""
    months = F.sequence(F.trunc("lo", "month"), F.col("hi"), F.expr("interval 1 month"))
    m = order_span(spark, sf_dir).select(F.explode(months).alias("month")).withColumn("third_friday", third_friday(F.col("month")))
    j = m.join(F.broadcast(holidays_df(spark, FIRST_YEAR, LAST_YEAR)), F.col("third_friday") == F.col("holiday"), "left")
    return j.select("month", "third_friday", F.when(F.col("holiday").isNotNull(), F.date_sub("third_friday", 1)).otherwise(F.col("third_friday")).alias("expiration"))


@query("""WITH e AS (SELECT event_id, ts, event_type || ' ' || CAST(user_id % 7 AS VARCHAR) AS title, value, row_number() OVER (PARTITION BY date_trunc('minute', ts), event_type || ' ' || CAST(user_id % 7 AS VARCHAR) ORDER BY event_id) AS r FROM events),
x AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-02-09', INTERVAL 7 DAY)) AS exp)
SELECT event_id, title, ts, (SELECT CAST(min(exp) AS DATE) FROM x WHERE exp >= date_trunc('day', ts)) AS expiration,
  CASE WHEN datediff('day', date_trunc('day', ts), (SELECT min(exp) FROM x WHERE exp >= date_trunc('day', ts))) <= 1 THEN '24h' WHEN datediff('day', date_trunc('day', ts), (SELECT min(exp) FROM x WHERE exp >= date_trunc('day', ts))) <= 2 THEN '48h' WHEN datediff('day', date_trunc('day', ts), (SELECT min(exp) FROM x WHERE exp >= date_trunc('day', ts))) <= 3 THEN '72h' ELSE 'later' END AS urgency
FROM e WHERE r = 1""")
def event_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once per minute and title, with the first expiration on or after each and how near it is.

    The few expirations are an array literal; the nearest one ahead is found
    inside the row, so the lookup needs no join.
    """
    e = table(spark, sf_dir, "events").withColumn("title", F.concat_ws(" ", "event_type", (F.col("user_id") % 7).cast("string")))
    e = e.groupBy(F.date_trunc("minute", "ts").alias("m"), "title").agg(F.min(F.struct("event_id", "ts")).alias("e")).select("title", "e.*")
    day = F.to_date("ts")
    ahead = F.array_min(F.filter(F.expr("sequence(date'2024-01-05', date'2024-02-09', interval 7 day)"), lambda x: x >= day))
    gap = F.datediff(F.col("expiration"), day)
    return e.withColumn("expiration", ahead).select("event_id", "title", "ts", "expiration", F.when(gap <= 1, "24h").when(gap <= 2, "48h").when(gap <= 3, "72h").otherwise("later").alias("urgency"))


@query(f"""WITH {METRICS_SQL}, {MACRO_SQL}, told AS (SELECT min(event_id) AS event_id, title, ts, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS event_date FROM macro GROUP BY title, ts),
listed AS (SELECT (SELECT min(event_date) FROM told) + dte AS expiration, dte, spot, atm_iv FROM metrics WHERE run_id = (SELECT max(run_id) FROM metrics) AND atm_iv IS NOT NULL)
SELECT event_id, title, event_date, expiration, dte, {sql_round('atm_iv', 6)} AS atm_iv, {sql_round('spot * atm_iv * sqrt(dte / 365e0)', 4)} AS move, {sql_round('atm_iv * sqrt(dte / 365e0) * 100', 6)} AS move_pct
FROM told ASOF LEFT JOIN listed ON told.event_date <= listed.expiration""")
def event_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each announcement once, with the latest run's first expiration on or after its New York day and the move that the volatility at the money implies until then.

    The run's expirations lie as many days behind the first announcement as they
    lie behind the run.
    """
    told = macro_events(spark, sf_dir).groupBy("title", "ts").agg(F.min("event_id").alias("event_id")).withColumn("event_date", F.to_date(F.from_utc_timestamp("ts", "America/New_York")))
    run = expiration_metrics_of(contracts(spark, sf_dir)).where("atm_iv is not null")
    last = run.agg(F.max("run_id").alias("run_id"))
    first = told.agg(F.min("event_date").alias("first"))
    listed = run.join(last, "run_id", "left_semi").join(F.broadcast(first)).select(F.date_add("first", F.col("dte")).alias("expiration"), "dte", "spot", "atm_iv")
    x = first_on_or_after(told, F.col("event_date"), listed, "expiration")
    share = F.col("atm_iv") * F.sqrt(F.col("dte") / F.lit(365.0))
    return x.select("event_id", "title", "event_date", "expiration", "dte", js_round(F.col("atm_iv"), 6).alias("atm_iv"), js_round(F.col("spot") * share, 4).alias("move"), js_round(share * 100, 6).alias("move_pct"))


@query(f"""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, DATE '2024-01-02' + CAST(c_custkey % 28 AS INTEGER) AS day FROM customer), f AS (SELECT * FROM c WHERE c_acctbal >= 1000 AND isodow(day) < 6 AND day NOT IN (SELECT holiday FROM {HOLIDAYS_SQL}))
SELECT day, c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'BMO' WHEN 1 THEN 'AMC' ELSE 'Unknown' END AS session, {sql_round('c_acctbal', 2)} AS revenue, row_number() OVER (PARTITION BY day ORDER BY round(c_acctbal, 2) DESC, c_custkey) AS place FROM f""")
def reporting_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that report on each trading day above a revenue floor, largest first."""
    c = table(spark, sf_dir, "customer").withColumn("day", F.date_add(F.lit("2024-01-02").cast("date"), (F.col("c_custkey") % 28).cast("int")))
    f = c.where((F.col("c_acctbal") >= 1000) & (F.weekday("day") < 5)).join(F.broadcast(holidays_df(spark, 2023, 2025)), F.col("day") == F.col("holiday"), "left_anti")
    session = F.when(F.col("c_custkey") % 3 == 0, "BMO").when(F.col("c_custkey") % 3 == 1, "AMC").otherwise("Unknown")
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(F.round("c_acctbal", 2)), "c_custkey"))
    return f.select("day", "c_custkey", session.alias("session"), js_round(F.col("c_acctbal"), 2).alias("revenue"), place.alias("place"))


@query("""SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS et_date, count(*) AS n, count(*) FILTER (isodow(timezone('America/New_York', timezone('UTC', ts))) < 6 AND hour(timezone('America/New_York', timezone('UTC', ts))) * 60 + minute(timezone('America/New_York', timezone('UTC', ts))) BETWEEN 570 AND 959) AS in_session FROM events GROUP BY 1""")
def market_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by New York date and how many fall into the session (570 <= minute < 960 on weekdays)."""
    minute = F.hour("et") * 60 + F.minute("et")
    e = events(spark, sf_dir).withColumn("et", F.from_utc_timestamp("ts", "America/New_York"))
    return e.groupBy(F.to_date("et").alias("et_date")).agg(F.count("*").alias("n"), F.count_if((F.weekday("et") < 5) & minute.between(570, 959)).alias("in_session"))
