"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vegaflow.plans import registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = registered()


def tidy(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iufb":
            df[c] = df[c].astype("float64").round(6) + 0.0
        elif df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda x: "None" if x is None or x is pd.NaT or x != x else str(x))
    return sorted(map(str, df.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY.SQL))
def test_matches_sql(spark, sf, con, name):
    got, want = REGISTRY.QUERIES[name](spark, sf).toPandas(), con.sql(REGISTRY.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and tidy(got) == tidy(want)


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.SQL)))
def test_gives_rows(spark, sf, name):
    assert REGISTRY.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))
