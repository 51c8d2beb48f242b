"""Column functions and series operators on hand-checked inputs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vegaflow.functions import calendar
from vegaflow.functions.numeric import bs_delta, bs_price, js_round, norm_cdf, safe_divide, to_number
from vegaflow.operators.series import as_of, band_join, first_seeded_ema, latest_per_key, mid_rank, runs, sma_seeded_ema, split_adjusted, upserted


def test_rounding_is_half_up(spark):
    r = spark.createDataFrame([(-2.5,), (2.5,), (0.125,)], "x double").select(js_round(F.col("x")), js_round(F.col("x"), 2)).collect()
    assert [x[0] for x in r] == [-2.0, 3.0, 0.0] and r[2][1] == 0.13


def test_numbers_and_division(spark):
    r = spark.createDataFrame([("1.5", 0.0), ("x", 2.0), ("Infinity", None)], "s string, d double").select(to_number(F.col("s")), safe_divide(F.lit(4.0), F.col("d"))).collect()
    assert [tuple(x) for x in r] == [(1.5, None), (None, 2.0), (None, None)]


def test_black_scholes_parity(spark):
    d = spark.createDataFrame([(100.0, 95.0, 0.5, 0.2), (100.0, 120.0, 0.1, 0.4)], "s double, k double, t double, v double")
    a = [F.col(c) for c in "sktv"]
    r = d.select("*", bs_price(*a, F.lit(True)).alias("c"), bs_price(*a, F.lit(False)).alias("p"), bs_delta(*a, F.lit(True)).alias("dc"), bs_delta(*a, F.lit(False)).alias("dp"), norm_cdf(F.lit(1.96)).alias("n")).collect()
    for x in r:
        assert x.c - x.p == pytest.approx(x.s - x.k * math.exp(-0.045 * x.t), abs=1e-9) and x.dc - x.dp == pytest.approx(1) and x.n == pytest.approx(0.975, abs=1e-4)


def test_averages():
    assert np.allclose(sma_seeded_ema(np.array([1, 2, 3, 5.0]), 3), [np.nan, np.nan, 2, 3.5], equal_nan=True)
    assert np.allclose(first_seeded_ema(np.array([1, 2, 3, 5.0]), 3), [1, 1.5, 2.25, 3.625])
    assert np.allclose(sma_seeded_ema(np.array([1, 3, np.nan, 5.0]), 2), [np.nan, 2, 2, 4], equal_nan=True)


def test_split_adjust(spark):
    d = spark.createDataFrame([("a", i, c) for i, c in enumerate([100.0, 102.0, 51.0, 52.0])], "s string, d int, c double")
    assert [r[0] for r in split_adjusted(d, "s", "d", "c").orderBy("d").select(js_round(F.col("adjusted_close"), 6)).collect()] == [50, 51, 51, 52]


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 3), ("b", 2), ("a", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 4, None), ("b", 9, "z")], "k string, u int, v string")
    got = sorted(tuple(r) for r in as_of(left, right.withColumn("at", F.col("u")), "t", "u", ["at", "v"], by=["k"]).fillna("-", ["v"]).fillna(-1, ["at"]).collect())
    assert got == [("a", 1, -1, "-"), ("a", 3, 3, "x"), ("a", 5, 4, "-"), ("a", 5, 4, "-"), ("b", 2, -1, "-")]
    strict = {(r[0], r[1]): r[2] for r in as_of(left, right.withColumn("at", F.col("u")), "t", "u", ["at"], by=["k"], strict=True).collect()}
    assert strict[("a", 3)] is None and strict[("a", 5)] == 4


def test_band_runs_ranks(spark):
    d = spark.createDataFrame([(0,), (5,), (9,)], "d int")
    assert sorted((r.d, r.t) for r in band_join(d, "d", F.lit(1), (0, 8), "t").collect()) == [(0, 0), (0, 1), (5, 4), (5, 5), (5, 6), (9, 8)]
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, -1, -1, 1])], "k string, i int, v int")
    assert [r.run_id for r in runs(s, ["k"], "i", F.col("v")).orderBy("i").collect()] == [1, 1, 2, 2, 3]
    v = spark.createDataFrame([("a", x) for x in (1, 2, 2, 4)], "k string, x int")
    assert {r.x: r.m for r in v.select("x", mid_rank("x", ["k"]).alias("m")).collect()} == {1: 12.5, 2: 50.0, 4: 87.5}


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, x string, y double")
    new = spark.createDataFrame([(2, None, 9.0), (3, "c", 3.0)], "k int, x string, y double")
    assert sorted(map(tuple, upserted(old, new, ["k"]).collect())) == [(1, "a", 1.0), (2, "b", 9.0), (3, "c", 3.0)]
    assert sorted(map(tuple, latest_per_key(old.withColumn("k", F.lit(1)), ["k"], ["y"]).collect())) == [(1, "b", 2.0)]


def test_calendar(spark):
    assert calendar.easter(2024) == dt.date(2024, 3, 31) and calendar.easter(2019) == dt.date(2019, 4, 21)
    h = calendar.market_holidays(2022, 2024)
    assert dt.date(2022, 12, 26) in h and dt.date(2022, 1, 1) not in h and dt.date(2021, 12, 31) not in h and dt.date(2024, 3, 29) in h and dt.date(2023, 1, 2) in h and dt.date(2024, 6, 19) in h
    r = spark.createDataFrame([(dt.date(2024, 3, 1),), (dt.date(2024, 11, 30),)], "d date").select(calendar.third_friday(F.col("d"))).collect()
    assert [x[0] for x in r] == [dt.date(2024, 3, 15), dt.date(2024, 11, 15)]
    assert calendar.trading_days(spark, "2024-03-25", "2024-04-02").count() == 6
