"""Trading calendar: holidays by rule, third Fridays, trading days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def easter(year: int) -> dt.date:
    """Western Easter Sunday by the anonymous Gregorian rule."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    l = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7  # noqa: E741
    m = (a + 11 * h + 22 * l) // 451
    month, day = divmod(h + l - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th (from 1; -1: the last) Monday = 0 .. Sunday = 6 of a month."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def observed(day: dt.date) -> dt.date | None:
    """Sunday holidays move to Monday, Saturday ones to Friday; a Saturday New Year is not observed."""
    if day.weekday() == 6:
        return day + dt.timedelta(1)
    if day.weekday() == 5:
        return None if (day.month, day.day) == (1, 1) else day - dt.timedelta(1)
    return day


def market_holidays(first_year: int, last_year: int) -> list[dt.date]:
    """Full-day closures of the US stock market by rule (Juneteenth from 2022)."""
    out = set()
    for y in range(first_year, last_year + 1):
        fixed = [dt.date(y, 1, 1), dt.date(y, 7, 4), dt.date(y, 12, 25)] + ([dt.date(y, 6, 19)] if y >= 2022 else [])
        out.update(d for d in map(observed, fixed) if d)
        out.update({nth_weekday(y, 1, 0, 3), nth_weekday(y, 2, 0, 3), easter(y) - dt.timedelta(2), nth_weekday(y, 5, 0, -1), nth_weekday(y, 9, 0, 1), nth_weekday(y, 11, 3, 4)})
    return sorted(out)


def holidays_df(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    return spark.createDataFrame([(d,) for d in market_holidays(first_year, last_year)], "holiday date")


def third_friday(day: Column) -> Column:
    """Third Friday of the month of ``day``."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "month"), 1), "Fri"), 14)


def trading_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """trading_date: weekdays between two dates that are no holidays."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("trading_date")).where(F.weekday("trading_date") < 5)
    h = holidays_df(spark, int(first[:4]), int(last[:4]))
    return days.join(F.broadcast(h), F.col("trading_date") == F.col("holiday"), "left_anti")
