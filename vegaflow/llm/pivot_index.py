"""Near-duplicate vectors through a pivot-permutation index.

A bounded sample of vectors serves as reference points. Every vector is
described by its permutation: the list of its nearest pivots from nearest to
farthest. Inverted lists hold the vectors under every two pivots of that list of
which one is among the first ``HEAD``; a pivot far down the list says little
about where a vector lies, so two of those make no list. Two vectors are
candidates if they share such a pair, whatever the number of vectors. Candidates
are verified by cosine in double precision.

Equal vectors form a class and only one of each goes on. A pair is looked at in
one list only, that of the least key both are in, so counts need no distinct; a
list is cut into blocks of bounded size, whose tasks give sums of links per
vector and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.llm.common import Workspace, mix64
from vegaflow.llm.components import components

#: Reference points (a bounded sample, by hash of the id) and nearest ones that describe a vector.
PIVOTS, NEAREST = 512, 8
#: Places of the permutation of which a list needs one; vectors to a block. Neither depends on the number of vectors, so a pair's chance to meet is the same in every table.
HEAD, BLOCK = 5, 1024
CHUNK_ROWS = 4096


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Double arrays; None for null, zero, and vectors with null or non-finite components."""
    out = []
    for v in column.to_pylist():
        x = None if not v or any(c is None for c in v) else np.array(v, "f8")
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled to length one; first by the largest component, so that no square overflows."""
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def readable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, dim, body (doubles as bytes), f1, f2; vectors that can link only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = rows_of(b.column(1))
            keep = pa.array([x is not None for x in rows], pa.bool_())
            bodies = [(x + 0.0).tobytes() for x in rows if x is not None]
            marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in bodies), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array([len(x) // 8 for x in bodies], pa.int32()), pa.array(bodies, pa.binary()), pa.array(marks[:, 0]), pa.array(marks[:, 1])], names=["id", "dim", "body", "f1", "f2"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vec_col).where(F.col(id_col).isNotNull()).mapInArrow(run, f"id {kind}, dim int, body binary, f1 bigint, f2 bigint")


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """(n, m) pivot numbers from nearest to farthest; ties by number."""
    sims = x @ pivots.T
    m = min(m, len(pivots))
    top = np.sort(np.argpartition(-sims, m - 1, axis=1)[:, :m], axis=1)
    order = np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


def list_keys(dims: np.ndarray, near: np.ndarray) -> np.ndarray:
    """(n, lists) 64-bit keys of the lists that permutations (rows of ``near``) are in; one of all where there is a single mark."""
    m = near.shape[1]
    places = [(i, j) for i, j in itertools.combinations(range(m), 2) if i < HEAD] if m > 1 else [(0, 0)]
    i, j = np.array(places).T
    lo, hi = np.minimum(near[:, i], near[:, j]).astype(np.uint64), np.maximum(near[:, i], near[:, j]).astype(np.uint64)
    key = mix64((dims.astype(np.uint64) + np.uint64(1))[:, None] * np.uint64(0x9E3779B97F4A7C15) + lo + np.uint64(1))
    return mix64(key * np.uint64(0x9E3779B97F4A7C15) + hi + np.uint64(1)).view("i8")


def posted(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """id, n, body, near (pivot numbers from nearest to farthest, as bytes), keys (of the inverted lists that the vector is in).

    A dimension with fewer vectors than pivots is one list, where all of them meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK_ROWS):
                b = whole.slice(lo, CHUNK_ROWS)
                dims = b.column(2).to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    own = b.take(pa.array(at))
                    x = np.frombuffer(b"".join(own.column(3).to_pylist()), "f8").reshape(len(at), dim)
                    near = nearest_pivots(unit(x), pivots[dim], NEAREST).astype("<i2") if dim in pivots else np.zeros((len(at), 1), "<i2")
                    keys = list_keys(dims[at], near)
                    marks = pa.array([r.tobytes() for r in near], pa.binary())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), marks, lists], names=["id", "n", "body", "near", "keys"])

    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "n", "dim", "body").mapInArrow(run, f"id {kind}, n bigint, body binary, near binary, keys array<bigint>")


def list_links(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """For the lists of one group: (a, b, n) where b null says that a has links to n vectors, and else a-b is of a spanning forest."""
    rows = rows.sort_values(["key", "mine", "id"], kind="stable")
    keys, mine = rows["key"].to_numpy(), rows["mine"].to_numpy()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    bodies, nears = rows["body"].to_numpy(), rows["near"].to_numpy()
    links: dict[int, int] = {}
    up: dict[int, int] = {}
    forest: list[tuple[int, int]] = []

    def root(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
        if hi - lo < 2:
            continue
        x = unit(np.frombuffer(b"".join(bodies[lo:hi]), "f8").reshape(hi - lo, -1))
        if i == j:
            p, q = np.nonzero(np.triu(x @ x.T >= least, 1))
        else:  # the rows of block i, then those of block j
            cut = int(np.searchsorted(mine[lo:hi], j))
            p, q = np.nonzero(x[:cut] @ x[cut:].T >= least)
            q = q + cut
        if not len(p):
            continue
        # a pair counts in the list of the least key that both are in
        near = np.frombuffer(b"".join(nears[lo:hi]), "<i2").reshape(hi - lo, -1)
        own = list_keys(np.full(hi - lo, x.shape[1]), near)
        for a in range(0, len(p), CHUNK_ROWS):
            u, v = p[a : a + CHUNK_ROWS], q[a : a + CHUNK_ROWS]
            both = (own[u][:, :, None] == own[v][:, None, :]).any(axis=2)
            here = np.where(both, own[u], np.iinfo(np.int64).max).min(axis=1) == keys[lo]
            for k, m in zip((u[here] + lo).tolist(), (v[here] + lo).tolist(), strict=True):
                s, t = int(ids[k]), int(ids[m])
                links[s] = links.get(s, 0) + int(n[m])
                links[t] = links.get(t, 0) + int(n[k])
                rs, rt = root(s), root(t)
                if rs != rt:
                    up[max(rs, rt)] = min(rs, rt)
                    forest.append((min(s, t), max(s, t)))
    a = list(links) + [x for x, _ in forest]
    b = [None] * len(links) + [y for _, y in forest]
    return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "n": pd.array([*links.values(), *[0] * len(forest)], "Int64")})


def near_vectors(spark: SparkSession, vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors of different length are never linked; null, zero and broken ones
    with nothing. An id stands for one vector: where rows that share it hold
    different ones, the one of the least fingerprint counts and all its rows get
    that answer. A row with a null id is linked with nothing, has a null
    component and is kept. An empty table gives no rows; other columns are not
    read.
    """
    work = Workspace(spark, "pivots")
    able = work.save(readable(vectors, id_col, vec_col), "read")
    least_mark = work.save(able.groupBy("id").agg(F.min("f1").alias("f1")), "marks")
    able = work.save(able.join(least_mark, ["id", "f1"], "left_semi").dropDuplicates(["id"]), "able")
    # written before it is joined: a class that holds a large share of the rows is then split over tasks
    classes = work.save(able.groupBy("f1", "f2", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    members = work.save(able.select("id", "f1", "f2", "dim").join(classes, ["f1", "f2", "dim"]).select("id", "rep", "n"), "members")
    reps = able.join(members.where("id = rep").select("id", "n"), "id").select("id", "n", "dim", "body")
    reps = work.save(reps, "reps")
    drawn = Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(5), "id"), "id")
    sampled = reps.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= PIVOTS)
    full = F.max("place").over(Window.partitionBy("dim")) == PIVOTS
    sample: dict[int, list[tuple[int, bytes]]] = {}
    # dimensions with fewer vectors than pivots need none, so none of theirs come to the driver
    for r in sampled.withColumn("full", full).where("full").select("dim", "place", "body").toLocalIterator():
        sample.setdefault(r["dim"], []).append((r["place"], bytes(r["body"])))
    pivots = {dim: unit(np.frombuffer(b"".join(x for _, x in sorted(own)), "f8").reshape(len(own), dim)) for dim, own in sample.items()}
    described = work.save(posted(reps, pivots), "described")
    # lists are counted by key alone; vectors travel only to lists where they meet another one
    lists = described.select("id", F.explode("keys").alias("key"))
    counts = lists.groupBy("key").count().where("count > 1")
    met = work.save(lists.join(counts, "key"), "met")
    blocks = F.ceil(F.col("count") / F.lit(BLOCK)).cast("int")
    dealt = met.join(described.drop("keys"), "id").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    groups = max(64, met.count() // 4096)
    small = dealt.where("blocks = 1").select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), "mine", "key", "id", "n", "body", "near")
    large = dealt.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("key").alias("g"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "id", "n", "body", "near")
    found = small.unionAll(large).groupBy("g", "i", "j").applyInPandas(lambda df: list_links(df, least), "a bigint, b bigint, n bigint")
    found = work.save(found, "found")
    work.drop("met")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    linked = components(work, found.where("b is not null").select("a", "b"), "parts").toDF("rep", "component")
    known = members.join(links, "rep", "left").join(linked, "rep", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = vectors.select(F.col(id_col).alias("id")).join(known, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
