"""Operators on ordered series: averages, adjustments, runs and as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Values that are averaged in one matrix product.
EMA_BLOCK = 128


def fading(start: float, values: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential average after each value, from a level before the first: a block of values is one product with the weights of its steps."""
    out = np.empty(len(values))
    steps = np.arange(min(EMA_BLOCK, len(values)))
    weights = np.tril(alpha * (1 - alpha) ** (steps[:, None] - steps[None, :]).clip(0))
    for lo in range(0, len(values), EMA_BLOCK):
        part = values[lo : lo + EMA_BLOCK]
        n = len(part)
        out[lo : lo + n] = weights[:n, :n] @ part + start * (1 - alpha) ** (steps[:n] + 1)
        start = out[lo + n - 1]
    return out


def sma_seeded_ema(values: np.ndarray, window: int) -> np.ndarray:
    """EMA with factor 2 / (window + 1), seeded by the mean of the first ``window`` valid values; gaps carry the last value."""
    if window <= 1:
        return values.copy()
    out = np.full(len(values), np.nan)
    valid = np.flatnonzero(np.isfinite(values))
    if len(valid) < window:
        return out
    seed = values[valid[:window]].sum() / window
    levels = np.concatenate([[seed], fading(seed, values[valid[window:]], 2 / (window + 1))])
    first = valid[window - 1]
    out[first:] = levels[np.searchsorted(valid[window - 1 :], np.arange(first, len(values)), "right") - 1]
    return out


def first_seeded_ema(values: np.ndarray, window: int) -> np.ndarray:
    """EMA seeded with the first value."""
    return np.concatenate([values[:1], fading(values[0], values[1:], 2 / (window + 1))]) if len(values) else values.copy()


def relative_rotation(df: DataFrame, keys: Sequence[str], order: str, value: str, smooth: int, slow: int, fast: int) -> DataFrame:
    """Ratio and momentum of a relative-strength series per key; a series is a key's days, and so bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rs = sma_seeded_ema(pdf[value].to_numpy("f8"), smooth)
        with np.errstate(divide="ignore", invalid="ignore"):
            level = sma_seeded_ema(rs, slow)
            ratio = np.where(level > 0, rs / level * 100, np.nan)
            pace = sma_seeded_ema(ratio, fast)
            momentum = np.where(pace > 0, ratio / pace * 100, np.nan)
        out = pdf[[*keys, order]].copy()
        out["rs_ratio"], out["rs_momentum"], out["n"] = ratio, momentum, len(pdf)
        return out[np.isfinite(ratio) & np.isfinite(momentum)]

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*keys, order))
    # a stated number of partitions: adaptive execution would give all series to one task
    tasks = min(4096, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, f"{kinds}, rs_ratio double, rs_momentum double, n long")


def split_adjusted(df: DataFrame, key: str, order: str, close: str) -> DataFrame:
    """Adds adjusted_close: a day-to-day ratio below 0.65 or above 1.55 rescales all earlier closes of the key."""
    w = Window.partitionBy(key).orderBy(order)
    ratio = F.col(close) / F.lag(close).over(w)
    jump = F.when((ratio < 0.65) | (ratio > 1.55), F.log(ratio)).otherwise(0.0)
    later = F.coalesce(F.sum("_jump").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return df.withColumn("_jump", jump).withColumn("adjusted_close", F.col(close) * F.exp(later)).drop("_jump")


def as_of(left: DataFrame, right: DataFrame, left_on: str, right_on: str, values: Sequence[str], by: Sequence[str] = (), strict: bool = False, forward: bool = False) -> DataFrame:
    """Left rows with the values of the right row latest at or before (``strict``: before) them, by keys; ``forward``: the first at or after.

    Both sides are stacked and the last right row is carried forward in one
    window per key, so the cost is one shuffle and one sort, however many rows
    match. Without keys the series itself must be bounded.
    """
    names = [c for c in left.columns]
    stacked = left.select(*names, F.col(left_on).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_right"))
    empty = [F.col(b) if b in by else F.lit(None).cast(left.schema[b].dataType).alias(b) for b in names]
    other = right.select(*empty, F.col(right_on).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.struct(*values).alias("_right"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("_at") if forward else F.asc("_at"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = 0 if strict else 1
    kind = F.col("_side") == mark
    found = stacked.withColumn("_left", F.lit(True)).unionByName(other.withColumn("_left", F.lit(False))).withColumn("_right", F.last("_right", ignorenulls=True).over(w))
    return found.where(kind & F.col("_left")).select(*names, *(F.col(f"_right.{v}").alias(v) for v in values))


def first_on_or_after(left: DataFrame, day: Column, right: DataFrame, right_day: str, reach: int = 400) -> DataFrame:
    """Left rows with the columns of the right row first on or after their day, at most ``reach`` days ahead; nulls without one.

    The right side is a calendar, and so bounded: each of its rows covers the days
    behind the one before, and left rows find theirs by an equality join.
    """
    w = Window.orderBy(right_day)
    start = F.greatest(F.date_add(F.lag(right_day).over(w), 1), F.date_sub(right_day, reach))
    cover = right.withColumn("_from", F.coalesce(start, F.date_sub(right_day, reach))).withColumn("_day", F.explode(F.sequence("_from", right_day))).drop("_from")
    return left.withColumn("_day", day).join(cover, "_day", "left").drop("_day")


def band_join(samples: DataFrame, centre: str, width: Column, targets: tuple[int, int], name: str) -> DataFrame:
    """Each sample once for every integer target within ``width``: a band join as an explode, never a nested loop."""
    around = F.sequence(F.greatest(F.col(centre) - width, F.lit(targets[0])), F.least(F.col(centre) + width, F.lit(targets[1])))
    return samples.where((F.col(centre) + width >= targets[0]) & (F.col(centre) - width <= targets[1])).withColumn(name, F.explode(around))


def runs(df: DataFrame, key: Sequence[str], order: str, state: Column) -> DataFrame:
    """Adds run_id: consecutive rows of a key with one state share it."""
    w = Window.partitionBy(*key).orderBy(order)
    changed = F.coalesce((F.col("_state") != F.lag("_state").over(w)).cast("int"), F.lit(1))
    return df.withColumn("_state", state).withColumn("_new", changed).withColumn("run_id", F.sum("_new").over(w)).drop("_new", "_state")


def sign_segments(df: DataFrame, day: str, a: str, b: str) -> DataFrame:
    """day, a, b, segment (from 0), side, crossing: stretches in which ``a`` is not under ``b``, or is, with the point where they cross at the end of one and the start of the next.

    The crossing lies between two days by the share of the earlier gap in both
    gaps (half where both are none); its day is rounded down. The series is one of
    days, and so bounded; days are distinct.
    """
    w = Window.orderBy(day)
    over = F.col(a) >= F.col(b)
    x = df.select(day, a, b).withColumns({"_side": F.when(over, "above").otherwise("below"), "_day": F.lag(day).over(w), "_a": F.lag(a).over(w), "_b": F.lag(b).over(w)})
    x = x.withColumn("_new", F.coalesce(F.col("_side") != F.lag("_side").over(w), F.lit(False))).withColumn("segment", F.sum(F.col("_new").cast("int")).over(w))
    first, second = F.abs(F.col("_a") - F.col("_b")), F.abs(F.col(a) - F.col(b))
    at = F.when(first + second > 0, first / (first + second)).otherwise(0.5)
    level = F.col("_a") + at * (F.col(a) - F.col("_a"))
    other = F.when(F.col("_side") == "above", "below").otherwise("above")
    ends = F.inline(F.array(F.struct((F.col("segment") - 1).alias("segment"), other.alias("side")), F.struct("segment", F.col("_side").alias("side"))))
    moved = F.date_add("_day", F.floor(at * F.datediff(day, "_day")).cast("int"))
    crossed = x.where("_new").select(moved.alias(day), level.alias(a), level.alias(b), "_side", "segment").select(day, a, b, ends).withColumn("crossing", F.lit(True))
    return x.select(day, a, b, "segment", F.col("_side").alias("side"), F.lit(False).alias("crossing")).unionByName(crossed)


def mid_rank(value: str, partition: Sequence[str]) -> Column:
    """(below + half of equal) / n * 100."""
    w = Window.partitionBy(*partition)
    return (F.rank().over(w.orderBy(value)) - 1 + F.lit(0.5) * F.count("*").over(Window.partitionBy(*partition, value))) / F.count("*").over(w) * 100


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Merge on a natural key: columns that ``new`` supplies win where they are not null, others stay."""
    n = new.select(*key, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c not in key))
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    j = old.join(n, list(key), "full_outer")
    pick = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c) if c in old.columns else F.lit(None)) for c in new.columns if c not in key}
    return j.select(*(pick[c].alias(c) if c in pick else F.col(c) for c in columns))


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by a partially aggregated maximum rather than a sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))
