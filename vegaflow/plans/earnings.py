"""Earnings queries: the calendar with its roster, predicate modes, earliest dates, filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.calendar import holidays_df
from vegaflow.functions.numeric import js_round
from vegaflow.functions.parameters import at_least, one_of
from vegaflow.plans.records import volume_roster
from vegaflow.plans.registry import SQL, query
from vegaflow.plans.schedule import HOLIDAYS_SQL
from vegaflow.sources.fixtures import FEED_DAYS, FEED_SQL, FEED_START, earnings_feed, sql_round, table

#: Revenue below which a name is not shown.
REVENUE_FLOOR = 5e8

ROSTER_SQL = f"roster AS (SELECT upper(symbol) AS ticker, anchor, hype, ov_rank, mc_rank FROM ({SQL['volume_roster']}))"
NAMES_SQL = f"""{FEED_SQL}, {ROSTER_SQL}, names AS (
  SELECT f.day, f.place, upper(f.ticker) AS ticker, company, CASE release_time WHEN 1 THEN 'BMO' WHEN 3 THEN 'AMC' ELSE 'Unknown' END AS session,
    CASE WHEN q1_rev > 0 THEN q1_rev WHEN q_sales > 0 THEN q_sales * 1e6 END AS revenue, coalesce(anchor, false) AS anchor, hype, ov_rank, mc_rank
  FROM feed f LEFT JOIN roster r ON r.ticker = upper(f.ticker)
  WHERE f.day < DATE '{FEED_START}' + {FEED_DAYS // 5 * 7} AND isodow(f.day) < 6 AND f.day NOT IN (SELECT holiday FROM {HOLIDAYS_SQL}))"""


def session_of(release_time: Column) -> Column:
    return F.when(release_time == 1, "BMO").when(release_time == 3, "AMC").otherwise("Unknown")


def reporting_names(spark: SparkSession, sf_dir: str, days: int = FEED_DAYS) -> DataFrame:
    """Names of the feed's first weekdays with the estimate, else last quarter's sales, as revenue; roster fields are null for names outside it."""
    weeks = at_least("days", days, 5) // 5 * 7
    f = earnings_feed(spark, sf_dir).where((F.col("day") < F.date_add(F.lit(FEED_START).cast("date"), weeks)) & (F.weekday("day") < 5))
    f = f.join(F.broadcast(holidays_df(spark, 2023, 2025)), F.col("day") == F.col("holiday"), "left_anti").withColumn("ticker", F.upper("ticker"))
    roster = volume_roster(spark, sf_dir).select(F.upper("symbol").alias("ticker"), "anchor", "hype", "ov_rank", "mc_rank")
    revenue = F.when(F.col("q1_rev") > 0, F.col("q1_rev")).when(F.col("q_sales") > 0, F.col("q_sales") * F.lit(1e6))
    j = f.join(roster, "ticker", "left")
    return j.select("day", "place", "ticker", "company", session_of(F.col("release_time")).alias("session"), revenue.alias("revenue"), F.coalesce("anchor", F.lit(False)).alias("anchor"), "hype", "ov_rank", "mc_rank")


@query(f"""WITH {NAMES_SQL} SELECT day, place AS feed_place, ticker, company, session, {sql_round('revenue', 2)} AS revenue, anchor, hype, ov_rank, mc_rank,
  row_number() OVER (PARTITION BY day ORDER BY revenue DESC, place) AS rank_of_day FROM names WHERE revenue >= {REVENUE_FLOOR!r}""")
def earnings_calendar(spark: SparkSession, sf_dir: str, floor: float = REVENUE_FLOOR) -> DataFrame:
    """Twenty weekdays of reporting names above a revenue floor with their roster ranks, largest first."""
    n = reporting_names(spark, sf_dir).where(F.col("revenue") >= F.lit(float(floor)))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("revenue"), "place"))
    return n.select("day", F.col("place").alias("feed_place"), "ticker", "company", "session", js_round(F.col("revenue"), 2).alias("revenue"), "anchor", "hype", "ov_rank", "mc_rank", rank.alias("rank_of_day"))


#: Which names a chart shows, by mode: a name for each and the condition it stands for.
MODES: dict[str, Callable[[], Column]] = {
    "anchor-50": lambda: F.col("anchor"),
    "topN-100": lambda: F.col("ov_rank") <= 100,
    "topN-250": lambda: F.col("ov_rank") <= 250,
    **{f"rev-{name}": (lambda least=least: F.col("revenue") >= F.lit(least)) for name, least in (("5B", 5e9), ("2B", 2e9), ("1B", 1e9), ("500M", 5e8))},
}
MODES_SQL = {"anchor-50": "anchor", "topN-100": "ov_rank <= 100", "topN-250": "ov_rank <= 250", "rev-5B": "revenue >= 5e9", "rev-2B": "revenue >= 2e9", "rev-1B": "revenue >= 1e9", "rev-500M": "revenue >= 5e8"}


@query(f"WITH {NAMES_SQL}, m AS ({' UNION ALL '.join(f"SELECT '{m}' AS mode, day, ticker FROM names WHERE {c}" for m, c in MODES_SQL.items())}) SELECT mode, day, count(*) AS names, count(DISTINCT ticker) AS tickers FROM m GROUP BY 1, 2")
def earnings_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names each mode shows on each day; a row is dealt to its modes in one pass."""
    n = reporting_names(spark, sf_dir)
    modes = F.array_compact(F.array(*(F.when(condition(), F.lit(m)) for m, condition in MODES.items())))
    return n.select("day", "ticker", F.explode(modes).alias("mode")).groupBy("mode", "day").agg(F.count("*").alias("names"), F.countDistinct("ticker").alias("tickers"))


def names_in_mode(spark: SparkSession, sf_dir: str, mode: str = "topN-100") -> DataFrame:
    """The names of one mode."""
    return reporting_names(spark, sf_dir).where(MODES[one_of("mode", mode, MODES)]())


EARLIEST_SQL = f"earliest AS (SELECT ticker, min(day) AS day, arg_min(session, (day - DATE '{FEED_START}') * 1000000000 + place) AS session FROM names GROUP BY 1)"


def earliest(names: DataFrame) -> DataFrame:
    """ticker, day, session: the first entry of each ticker in the order of days and of the feed."""
    first = names.groupBy("ticker").agg(F.min(F.struct("day", "place", "session")).alias("f"))
    return first.select("ticker", "f.day", "f.session")


@query(f"WITH {NAMES_SQL}, {EARLIEST_SQL} SELECT ticker, day, session, CAST(day - DATE '{FEED_START}' AS INTEGER) AS days_to FROM earliest")
def earliest_earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next report of each ticker; the first entry wins."""
    return earliest(reporting_names(spark, sf_dir)).withColumn("days_to", F.datediff("day", F.lit(FEED_START).cast("date")))


FILTERS = {"all": lambda: F.lit(True), "hide": lambda: F.col("day").isNull(), "only": lambda: F.col("day").isNotNull()}


@query(f"""WITH {NAMES_SQL}, {EARLIEST_SQL}, s AS (SELECT r.ticker, e.day FROM roster r LEFT JOIN earliest e USING (ticker))
SELECT 'all' AS filter, ticker, day FROM s UNION ALL SELECT 'hide', ticker, day FROM s WHERE day IS NULL UNION ALL SELECT 'only', ticker, day FROM s WHERE day IS NOT NULL""")
def earnings_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster names under each of the three filters: all, without a coming report, only with one."""
    roster = volume_roster(spark, sf_dir).select(F.upper("symbol").alias("ticker"))
    s = roster.join(earliest(reporting_names(spark, sf_dir)).drop("session"), "ticker", "left")
    shown = F.array_compact(F.array(*(F.when(condition(), F.lit(name)) for name, condition in FILTERS.items())))
    return s.select(F.explode(shown).alias("filter"), "ticker", "day")


@query("""WITH s AS (SELECT p_brand AS symbol, min(p_size) % 5 AS k FROM part GROUP BY 1) SELECT 'sector ' || CAST(k AS VARCHAR) AS sector, count(*) AS symbols FROM s GROUP BY 1""")
def sector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster symbols of each sector."""
    s = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.min("p_size") % 5).alias("k"))
    return s.groupBy(F.concat(F.lit("sector "), F.col("k").cast("string")).alias("sector")).agg(F.count("*").alias("symbols"))
