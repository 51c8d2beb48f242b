"""End-of-day work by date: phases that replace the days they wrote, and a ledger that resumes them.

A phase gives rows with a ``trading_date``. Its table is partitioned by that
date and written with dynamic overwrite, so a day that is run again replaces its
own rows and no others; a day for which a phase gives no rows keeps what it has.
The ledger has a row for every day, phase and attempt;
days that a phase has finished are not run again unless that is forced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "day date, phase string, place int, attempt int, status string, n_rows bigint, message string"

#: (days) -> rows of these days; a phase may leave days out that have nothing.
Phase = Callable[[Sequence[date]], DataFrame]


def resolve_day(runs: DataFrame, today: date, override: date | None = None, back: int = 5) -> date:
    """The day to work on: the given one, else the last of the past ``back`` days with a successful run (trading_date, status)."""
    if override:
        return override
    near = runs.where((F.col("status") == "success") & F.col("trading_date").between(F.lit(today - timedelta(days=back - 1)), F.lit(today)))
    last = near.agg(F.max("trading_date")).first()[0]
    if last is None:
        raise ValueError(f"no successful run in the {back} days up to {today}")
    return last


def ledger(spark: SparkSession, root: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger")


def state_of(book: DataFrame) -> DataFrame:
    """day, phase, place, attempts, status, n_rows, message: the last attempt of each."""
    return book.groupBy("day", "phase", "place").agg(F.max("attempt").alias("attempts"), *(F.max_by(c, "attempt").alias(c) for c in ("status", "n_rows", "message")))


def run_days(spark: SparkSession, root: str, phases: dict[str, Phase], days: Sequence[date], force: bool = False) -> DataFrame:
    """Run the phases in order over the days that each has not finished, one job a phase; the state of the ledger for these days.

    A phase that fails is noted for its days and does not stop the others; the
    next call takes up only what is not finished.
    """
    days = sorted(set(days))
    for place, (name, phase) in enumerate(phases.items()):
        mine = ledger(spark, root).where((F.col("phase") == name) & F.col("day").isin(days))
        before = {r["day"]: r for r in state_of(mine).collect()}  # as many rows as days asked for
        left = [d for d in days if force or d not in before or before[d]["status"] != "success"]
        if not left:
            continue
        attempt = {d: before[d]["attempts"] + 1 if d in before else 1 for d in left}
        try:
            rows = phase(left).where(F.col("trading_date").isin(left))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trading_date").parquet(f"{root}/{name}")
            written = spark.read.parquet(f"{root}/{name}").where(F.col("trading_date").isin(left)).groupBy("trading_date").count()
            counts = {r[0]: r[1] for r in written.collect()}
            notes = [(d, name, place, attempt[d], "success", counts.get(d, 0), None) for d in left]
        except Exception as e:  # noqa: BLE001 - the ledger says what went wrong
            notes = [(d, name, place, attempt[d], "error", None, str(e)[:200]) for d in left]
        spark.createDataFrame(notes, LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return state_of(ledger(spark, root).where(F.col("day").isin(days)))
