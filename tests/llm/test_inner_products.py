"""Exact top-k search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vegaflow.llm import inner_products
from vegaflow.llm.common import table
from vegaflow.llm.queries import op12_inner_products

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, step=50, k=5, scale=256):
    """Every product in Python integers."""
    kept = [(i, [int(np.floor(float(c) * scale)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, a in kept:
        if q % step == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    return sorted(out)


def got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()))


def test_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    assert got(op12_inner_products(spark, sf)) == brute(rows)


@pytest.mark.parametrize("small", [False, True])
def test_lengths_copies_and_ties(spark, monkeypatch, small):
    """Very different lengths, many equal vectors, negative products only; with blocks of any size."""
    if small:
        for name, n in (("PACK", 16), ("QUERIES", 16), ("CANDIDATES", 64), ("HEAD", 3), ("CHUNK", 5)):
            monkeypatch.setattr(inner_products, name, n)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 12)) * rng.lognormal(0, 1, (500, 1)), np.repeat(rng.normal(size=(1, 12)), 300, axis=0), np.zeros((40, 12)), -np.ones((10, 12))])
    rows = list(enumerate(x[rng.permutation(len(x))].tolist()))
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute(rows, step=7)
    assert got(inner_products.top_products(spark, df, F.col("id") % 7 == 0)) == want


def test_bounds_spare_products():
    """Of lengths that differ, and of vectors near a few axes, few pairs get their exact product; none that belongs is lost."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 32))
    x = np.floor(256 * (rng.normal(size=(3000, 4)) @ base + 0.05 * rng.normal(size=(3000, 32))) * rng.lognormal(0, 0.7, (3000, 1)))
    order = np.argsort(-np.sqrt((x * x).sum(axis=1)))
    axes = np.linalg.svd(x[:1000])[2].T
    s = inner_products.Search(np.arange(-50, 0), x[:50], axes, np.full(50, -np.inf), 5)
    for lo in range(0, 3000, 100):
        s.see(order[lo : lo + 100], x[order[lo : lo + 100]])
    best = s.best()
    for q in range(50):
        full = x @ x[q]
        assert best[best.query_id == q - 50].score.tolist() == np.sort(full)[::-1][:5].astype(int).tolist()
    assert s.looked < 0.2 * 50 * 3000


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("inf"), 1.0]), (3, [1.0, None]), (None, [1.0, 1.0]), (50, [1.0, 2.0]), (4, [0.5, -0.5]), (100, [1.0, 2.0, 3.0]), (150, []), (151, []), (200, [1e30, 1e30]), (201, [-1e30, 1e12]), (0, [1.0, 2.0]), (250, [7.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, b"b", "d") for r in rows], SCHEMA + ", id int, body binary, dim string")
    limit = lambda v: v and [None if c is None else float(np.clip(c, -(2.0**54), 2.0**54)) for c in v]
    want = brute([(i, v if v is None or not all(c is not None and np.isfinite(c) for c in v) else limit(v)) for i, v in dict(rows).items()])
    r = got(inner_products.top_products(spark, df))
    assert r == want and (150, 1, 151, 0) in r and not [x for x in r if x[0] in (100, 250)]
    assert inner_products.top_products(spark, df.where("false")).count() == 0
    assert inner_products.top_products(spark, df.where("vec_id = 4")).count() == 0
