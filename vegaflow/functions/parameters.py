"""Checks of what a caller asks a query for; a wrong value is refused before anything is read."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(name: str, value: str | dt.date | None) -> dt.date | None:
    """An ISO date; None stays None."""
    if value is None or isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(value)
    except ValueError:
        raise ValueError(f"{name}: {value!r} is no date like 2024-01-31") from None


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(high, int(value)))


def at_least(name: str, value: int, low: int) -> int:
    if int(value) < low:
        raise ValueError(f"{name}: {value} is under {low}")
    return int(value)


def one_of(name: str, value: str, allowed: Collection[str]) -> str:
    if value not in allowed:
        raise ValueError(f"{name}: {value!r} is none of {', '.join(allowed)}")
    return value


def between_days(column: str, first: str | dt.date | None, last: str | dt.date | None) -> Column:
    """Condition that a date lies within the asked days; an open end asks for all."""
    a, b = day("first", first), day("last", last)
    if a and b and a > b:
        raise ValueError(f"first {a} is after last {b}")
    out = F.lit(True)
    if a:
        out = out & (F.col(column) >= F.lit(a))
    if b:
        out = out & (F.col(column) <= F.lit(b))
    return out
