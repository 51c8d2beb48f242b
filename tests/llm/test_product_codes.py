"""Heap Lloyd against plain Lloyd rounds over all parts and entries."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vegaflow.llm import heap_lloyd
from vegaflow.llm.common import table

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{id: (code, error, label_error)} and the digest, by whole integers and every distance."""
    kept = [(i, [int(Fraction(float(c)) * scale // 1) for c in v], x) for i, v, x in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v, _ in kept], np.int64)
    at = sorted(range(len(kept)), key=lambda i: kept[i][0])[:entries]
    w = x.shape[1] // parts
    books = [x[at, p * w : (p + 1) * w] for p in range(parts)]

    def assign(p):
        own = x[:, p * w : (p + 1) * w]
        return np.concatenate([((own[lo : lo + 500, None] - books[p][None]) ** 2).sum(axis=2) for lo in range(0, len(own), 500)])

    for _ in range(rounds):
        for p in range(parts):
            code = assign(p).argmin(axis=1)
            own = x[:, p * w : (p + 1) * w]
            books[p] = np.array([own[code == c].sum(axis=0) // (code == c).sum() if (code == c).any() else books[p][c] for c in range(len(books[p]))])
    found = [assign(p) for p in range(parts)]
    codes, error = np.array([d.argmin(axis=1) for d in found]).T, sum(d.min(axis=1) for d in found)
    of = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        of[label] = of.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((k[0], "".join(f"{c:02x}" for c in r), int(e), of[k[2]]) for k, r, e in zip(kept, codes, error, strict=True)), key=str), digest


def got(df):
    r = df.collect()
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(((x["vec_id"], x["code"], x["error"], x["label_error"]) for x in r), key=str), {x["codebooks_sha256"] for x in r}


def test_whole_table(spark, sf):
    v = table(spark, sf, "embeddings")
    want, digest = plain([(r["vec_id"], r["embedding"], r["label"]) for r in v.collect()])
    assert got(heap_lloyd.product_codes(spark, v)) == (want, {digest})


@pytest.mark.parametrize("block", [2048, 7])
def test_clusters_ties_and_copies(spark, monkeypatch, block):
    """Close clusters, equal rows and small whole numbers (ties); few entries and many rounds, in blocks of any size."""
    monkeypatch.setattr(heap_lloyd, "BLOCK", block)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(400, 8)), rng.integers(-2, 3, (300, 8)) / 1024, np.repeat(rng.normal(size=(1, 8)), 350, axis=0)])
    rows = [(i, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(x[rng.permutation(len(x))])]
    for entries, rounds in ((256, 4), (20, 12), (1, 3)):
        want, digest = plain(rows, entries=entries, rounds=rounds)
        assert got(heap_lloyd.product_codes(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries, rounds=rounds)) == (want, {digest})


def test_few_parts_are_measured_again():
    """Heaps leave most parts alone once entries move little, and lose none that should move."""
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(2000, 16)) * 1024)
    book = heap_lloyd.Book([np.tile(v, 4) for v in x[:64]], 4)
    code, slack = heap_lloyd.nearest(x, book.entries[0])
    heaps, seen = heap_lloyd.Heaps.build(code, slack, 64), []
    measured = heap_lloyd.nearest
    for _ in range(12):
        new = np.array([x[code == c].sum(axis=0) // (code == c).sum() if (code == c).any() else book.entries[0][c] for c in range(64)])
        book.moved([new] * 4)
        heap_lloyd.nearest = lambda rows, e: seen.append(len(rows)) or measured(rows, e)
        heaps, *_ = heaps.settle(x, new, book.drift[0])
        heap_lloyd.nearest = measured
        code = measured(x, new)[0]
        assert (heaps.codes() == code).all()
    assert seen[-1] < 0.8 * len(x)


def test_odd_rows(spark):
    rows = [(1, [0.5] * 4, 1), (2, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [float("nan")] * 4, 1), (5, [1.0, 2.0], None), (None, [0.25] * 4, None), (6, [1e30, -1e30, 0.0, 1.0], None), (1, [0.5] * 4, 1), (7, [], 2)]
    df = spark.createDataFrame([(*r, "c", 1, b"b") for r in rows], SCHEMA + ", code string, part int, body binary")
    r = {(x["vec_id"], x["code"]): x for x in heap_lloyd.product_codes(spark, df).collect()}
    assert len(r) == 5 and {k[0] for k in r} == {1, None, 5, 6, 7}
    assert r[5, None]["error"] is None and r[7, None]["label_error"] is None and r[1, "00000000"]["error"] == 4 * (512 - 426) ** 2
    assert heap_lloyd.product_codes(spark, df.where("false")).count() == 0
    only_null = heap_lloyd.product_codes(spark, df.where("vec_id is null")).collect()
    assert len(only_null) == 1 and only_null[0]["code"] is None
    big = [(i, [float(i) * 1e17, -3e15 * i, 7.0 * i, 1e5 * i], 0) for i in range(4)]
    x = heap_lloyd.product_codes(spark, spark.createDataFrame(big, SCHEMA), entries=2).collect()
    assert len(x) == 4 and max(v["error"] for v in x) == 2**63 - 1 and {v["label_error"] for v in x} == {2**63 - 1}


def test_a_dimension_that_four_does_not_divide(spark):
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=6).tolist(), 0) for i in range(300)]
    r = heap_lloyd.product_codes(spark, spark.createDataFrame(rows, SCHEMA), entries=16).agg(F.count("code").alias("n"), F.min(F.length("code")).alias("l"), F.min("error").alias("e")).first()
    assert (r["n"], r["l"]) == (300, 8) and r["e"] >= 0
