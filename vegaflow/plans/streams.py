"""Streams run over the tables, checked against their batch results.

With the available-now trigger the windows that the final watermark has not
passed stay open and are not part of the result, as in a live run; the oracle
states that rule in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vegaflow.functions.numeric import js_round
from vegaflow.plans.registry import query
from vegaflow.sources.fixtures import sql_round
from vegaflow.streaming.bars import drain, event_stream, once_each, running_levels, session_gate, sliding_counts, tumbling_bars, user_sessions

FINAL = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""WITH b AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS bucket, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, count(*) AS n FROM events GROUP BY 1)
SELECT bucket, {', '.join(f"{sql_round(c, 6)} AS {c}" for c in ('open', 'high', 'low', 'close'))}, n FROM b WHERE bucket + INTERVAL 30 MINUTE <= {FINAL}""")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour bars built by a stream."""
    b = drain(spark, tumbling_bars(event_stream(spark, sf_dir)))
    return b.select("bucket", *(js_round(F.col(c), 6).alias(c) for c in ("open", "high", "low", "close")), "n")


@query(f"""WITH s AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS bucket, event_type FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT bucket, event_type, count(*) AS n FROM s WHERE bucket + INTERVAL 1 HOUR <= {FINAL} GROUP BY ALL""")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per type in hour windows that slide by 15 minutes."""
    return drain(spark, sliding_counts(event_stream(spark, sf_dir)))


@query(f"""WITH o AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o)
SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS n, {sql_round('sum(value)', 4)} AS total FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {FINAL}""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users built by a stream."""
    return drain(spark, user_sessions(event_stream(spark, sf_dir))).withColumn("total", js_round(F.col("total"), 4))


@query("""SELECT event_id, event_type FROM events WHERE isodow(timezone('America/New_York', timezone('UTC', ts))) < 6
  AND hour(timezone('America/New_York', timezone('UTC', ts))) + minute(timezone('America/New_York', timezone('UTC', ts))) / 60e0 >= 9.5e0 AND hour(timezone('America/New_York', timezone('UTC', ts))) + minute(timezone('America/New_York', timezone('UTC', ts))) / 60e0 < 16.5e0""")
def stream_session_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within market hours, each id once although the stream repeats it."""
    e = event_stream(spark, sf_dir)
    return drain(spark, once_each(session_gate(e.unionByName(e))).select("event_id", "event_type"))


@query(f"""WITH RECURSIVE o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
e AS (SELECT event_type, i, value AS level FROM o WHERE i = 1 UNION ALL SELECT o.event_type, o.i, o.value * 0.2e0 + e.level * (1 - 0.2e0) FROM e JOIN o ON o.event_type = e.event_type AND o.i = e.i + 1)
SELECT event_type, {sql_round('max_by(level, i)', 6)} AS level, max(i) AS seen FROM e GROUP BY 1""")
def stream_running_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed level of each event type from state kept across micro-batches."""
    d = drain(spark, running_levels(event_stream(spark, sf_dir)), "update")
    last = d.groupBy("event_type").agg(F.max(F.struct("seen", "level")).alias("r"))
    return last.select("event_type", js_round(F.col("r.level"), 6).alias("level"), "r.seen")
