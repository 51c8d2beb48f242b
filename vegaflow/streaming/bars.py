"""Streams over a folder of event files.

Each builder takes a streaming DataFrame of events (event_id, ts, user_id,
event_type, value) and returns a streaming DataFrame, so the same plan serves a
file source, a message queue or a test. ``drain`` runs one with the
available-now trigger into a table of the shared folder, which is how a
scheduled batch consumes what has arrived since the last run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vegaflow.session import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, files: int = 64) -> DataFrame:
    """Events of the folder as a stream, ts as an instant; a micro-batch takes at most so many files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files).parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def session_gate(events: DataFrame, first_hour: float = 9.5, last_hour: float = 16.5) -> DataFrame:
    """Only weekdays within the hours of New York."""
    et = F.from_utc_timestamp("ts", "America/New_York")
    hour = F.hour(et) + F.minute(et) / F.lit(60.0)
    return events.where((F.weekday(et) < 5) & (hour >= first_hour) & (hour < last_hour))


def ingest_gate(events: DataFrame, closed_days: Sequence[str] = (), force: bool = False, first_hour: float = 9.5, last_hour: float = 16.5) -> DataFrame:
    """What a timed run takes up: weekdays that are no holiday, from the first to the last hour of New York, both included; all of it when forced."""
    if force:
        return events
    et = F.from_utc_timestamp("ts", "America/New_York")
    hour = F.hour(et) + F.minute(et) / F.lit(60.0)
    return events.where((F.weekday(et) < 5) & ~F.to_date(et).cast("string").isin(*closed_days) & hour.between(first_hour, last_hour))


def tumbling_bars(events: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Open, high, low, close and count per tumbling window, final once the watermark has passed it."""
    w = F.window("ts", width)
    bars = events.withWatermark("ts", late).groupBy(w.alias("w")).agg(
        F.min_by("value", F.struct("event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("event_id")).alias("close"), F.count("*").alias("n")
    )
    return bars.select(F.col("w.start").alias("bucket"), "open", "high", "low", "close", "n")


def sliding_counts(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Events per type in sliding windows."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type")
    return g.count().select(F.col("w.start").alias("bucket"), "event_type", F.col("count").alias("n"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("until"), "n", "total")


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, however often pages overlap, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def completeness(events: DataFrame, expected: int, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Runs per window against the expected number."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.lit(float(expected))
    return g.select(F.to_date("w.start").alias("day"), "n", F.when(share >= 0.93, "pass").when(share >= 0.7, "warn").otherwise("fail").alias("status"))


def running_levels(events: DataFrame, alpha: float = 0.2) -> DataFrame:
    """First-value-seeded EMA of each type, kept as state across micro-batches.

    A batch's rows of a type are sorted in one task; the source's rate options
    (``maxFilesPerTrigger``) bound a batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, seen = state.get if state.exists else (None, 0)
        rows = pd.concat([f[["ts", "event_id", "value"]] for f in frames]).sort_values(["ts", "event_id"])
        x = rows["value"].to_numpy("f8")
        seen += len(x)
        if level is None:
            level, x = x[0], x[1:]
        for part in np.array_split(x, max(1, len(x) // 500)):  # factors of longer runs would underflow
            fade = (1 - alpha) ** np.arange(len(part), -1, -1.0)
            level = float(level * fade[0] + alpha * (part @ fade[1:]))
        state.update((level, seen))
        yield pd.DataFrame({"event_type": [key[0]], "level": [level], "seen": [seen]})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, level double, seen long", "level double, seen long", "update", GroupStateTimeout.NoTimeout)


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that has arrived, into a table of the shared folder, and read that."""
    path = shared_folder(spark, "stream")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def upsert_batches(stream: DataFrame, target: str, keys: list[str], order: list[str], state: str) -> Any:
    """Start a stream whose batches overwrite earlier rows of the same keys.

    Of a batch's rows of one key the last by ``order`` (then by all columns) is
    kept. A batch owns its folder and replaces it when it is run again, so a
    replay after a failure changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys and c not in order]
        last = batch.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")
        last.write.mode("overwrite").parquet(f"{target}/_batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Rows of an upserted table: the last batch of each key."""
    d = spark.read.parquet(target)
    rest = [c for c in d.columns if c not in keys and c != "_batch"]
    return d.groupBy(*keys).agg(F.max(F.struct("_batch", *rest)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def stream_query(build: Callable[[DataFrame], DataFrame], mode: str = "append") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: drain(spark, build(event_stream(spark, sf_dir)), mode)
