"""Ingest runs as streams: contracts of complete runs only, and which sources are alive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def complete_runs(headers: DataFrame, contracts: DataFrame, within: str = "130 days", late: str = "1 day") -> DataFrame:
    """Contracts (run_id, at, ...) of the runs whose header (run_id, captured_at, status) says success.

    Headers of partial runs are dropped before the join, so their contracts find
    nothing and stay out. A contract arrives between its run's capture and
    ``within`` later; both sides have watermarks, so a row is kept as state only
    until its partner can no longer come.
    """
    h = headers.where("status = 'success'").select(F.col("run_id").alias("of_run"), "captured_at").withWatermark("captured_at", late)
    c = contracts.withWatermark("at", late)
    near = (F.col("run_id") == F.col("of_run")) & (F.col("at") >= F.col("captured_at")) & (F.col("at") <= F.col("captured_at") + F.expr(f"interval {within}"))
    return c.join(h, near).drop("of_run")


class Liveness(StatefulProcessor):
    """Per source: LIVE when it speaks after silence, STALE once it has been silent for a while, by a timer and not by its next word."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms bigint")

    def row(self, key: Any, at_ms: int, state: str) -> tuple:
        return key, pd.Timestamp(at_ms, unit="ms"), state

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - named by Spark
        held = self.last.get()[0] if self.last.exists() else None
        told, last = [], held
        for at in sorted(int(t) for f in rows for t in f["at_ms"]):
            if last is None or at - last > self.silence_ms:
                if last is not None:
                    told.append(self.row(key[0], last + self.silence_ms, "STALE"))
                told.append(self.row(key[0], at, "LIVE"))
            last = at if last is None else max(last, at)
        if held is not None:
            self.handle.deleteTimer(held + self.silence_ms)
        self.last.update((last,))
        self.handle.registerTimer(last + self.silence_ms)
        yield pd.DataFrame(told, columns=["source", "told_at", "state"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame([self.row(key[0], last + self.silence_ms, "STALE")], columns=["source", "told_at", "state"])

    def close(self) -> None:
        pass


def liveness(events: DataFrame, source: str = "event_type", silence: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """source, told_at, state (LIVE or STALE): changes of each source, told once each.

    State is one instant per source and goes when its timer fires. Needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    slim = events.select(F.col(source).cast("string").alias("source"), "ts", F.unix_millis("ts").alias("at_ms")).withWatermark("ts", late)
    return slim.groupBy("source").transformWithStateInPandas(statefulProcessor=Liveness(ms), outputStructType="source string, told_at timestamp, state string", outputMode="Append", timeMode="EventTime")
