"""Sinks: appends, keyed upserts, conditional writes and retention over Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vegaflow.operators.series import upserted


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str], version: int) -> DataFrame:
    """Write the next version of a keyed table: ``path/v=<version>`` from the one before and the new rows.

    A version is written whole before a reader is pointed at it, so a failed job
    leaves the earlier one untouched.
    """
    merged = upserted(spark.read.parquet(f"{path}/v={version - 1}"), new, key) if version else new
    merged.write.mode("overwrite").parquet(f"{path}/v={version}")
    return spark.read.parquet(f"{path}/v={version}")


def write_run(header: DataFrame, contracts: DataFrame, levels: DataFrame, path: str) -> None:
    """A run's tables; contracts only of runs that are not partial."""
    append(header, f"{path}/runs")
    append(levels, f"{path}/levels")
    whole = header.where("status = 'success'").select("run_id")
    append(contracts.join(whole, "run_id", "left_semi"), f"{path}/contracts", "trading_date")


def expire(df: DataFrame, date: str, today: str, keep_days: int) -> DataFrame:
    """Rows not older than ``keep_days``; 0 keeps all. On a table partitioned by the date this reads no old partition."""
    return df if keep_days == 0 else df.where(F.col(date) >= F.date_sub(F.lit(today).cast("date"), keep_days))
