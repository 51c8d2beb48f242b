"""The operators find the same in a large table as in a small one."""

import numpy as np

from vegaflow.llm import pivot_index


def test_links_do_not_go_as_the_table_grows(spark):
    """2,500 pairs at a cosine just over 0.95: as many links alone as among 5,000 others, and more than 99.9 % of them."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(2500, 64)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * side
    rows = np.vstack([a, b, unit(rng.normal(size=(5000, 64)))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id bigint, embedding array<double>")
    links = lambda n: sum(r["n_links"] for r in pivot_index.near_vectors(spark, df.where(f"vec_id < {n}")).collect())
    assert links(10000) >= 0.999 * 5000
    assert links(5000) >= 0.999 * 5000


def test_a_small_dimension_is_exact_beside_a_large_one(spark):
    """300 vectors of 8 dimensions, beside 6,000 of 64, are linked as by brute force."""
    rng = np.random.default_rng(12)
    small, large = rng.normal(size=(300, 8)), rng.normal(size=(6000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate([*small, *large])], "vec_id bigint, embedding array<double>")
    u = small / np.linalg.norm(small, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pivot_index.near_vectors(spark, df, least=0.9).collect()}
    assert want.sum() > 0 and [got[i] for i in range(300)] == want.tolist()


def test_many_small_dimensions_need_no_pivots(spark):
    """Twins in 60 dimensions of a few vectors each are linked; without a usable vector nothing is."""
    rng = np.random.default_rng(13)
    rows = [(10 * d + i, x.tolist()) for d in range(2, 62) for x in [rng.normal(size=d)] for i, x in enumerate((x, 2 * x, -x))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivot_index.near_vectors(spark, df).collect()}
    assert got == {i: (1, i - i % 10) if i % 10 < 2 else (0, i) for i, _ in rows}
    nothing = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pivot_index.near_vectors(spark, nothing).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
