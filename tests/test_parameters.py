"""What queries refuse and how they are narrowed."""

import datetime as dt

import pytest

from vegaflow.functions import parameters
from vegaflow.plans import earnings, payloads


def test_values_are_checked():
    assert parameters.day("d", None) is None and parameters.day("d", "2024-01-31") == dt.date(2024, 1, 31)
    assert parameters.clamped(900, 1, 252) == 252 and parameters.at_least("n", 5, 5) == 5
    for call in (lambda: parameters.day("d", "31.1.2024"), lambda: parameters.at_least("n", 4, 5), lambda: parameters.one_of("mode", "x", ("a", "b")), lambda: parameters.between_days("t", "2024-02-01", "2024-01-01")):
        with pytest.raises(ValueError):
            call()


def test_asked_days_are_a_part_of_all(spark, sf):
    every = payloads.gex_history(spark, sf).toPandas().sort_values("trading_date").reset_index(drop=True)
    some = payloads.gex_history(spark, sf, "1999-01-01", "1999-03-31").toPandas().sort_values("trading_date").reset_index(drop=True)
    want = every[(every.trading_date >= dt.date(1999, 1, 1)) & (every.trading_date <= dt.date(1999, 3, 31))].reset_index(drop=True)
    assert len(some) > 20 and some.equals(want) and some.hv_10d.notna().all()


def test_modes_and_pages(spark, sf):
    shown = earnings.names_in_mode(spark, sf, "rev-5B")
    assert shown.count() == shown.where("revenue >= 5e9").count() > 0
    with pytest.raises(ValueError):
        earnings.names_in_mode(spark, sf, "all")
    assert {r["block"] for r in payloads.page_state_of(spark, sf, "/vix/").collect()} == {"vix", "vix_curve", "vrp"}
