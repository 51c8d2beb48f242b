"""Exact top-k search by inner product over vectors of descending length.

Candidates are sorted by length and packed into blocks. Every vector is turned
into the axes of a singular value decomposition of its dimension's sample, so
that the first few coordinates hold most of it. For a query and a candidate, the
product of these heads plus the product of the lengths of the rests (Cauchy and
Schwarz) bounds the inner product from above; only pairs whose bound reaches the
query's threshold get their exact whole-number product. A first pass over the
longest block gives thresholds; a block whose longest vector cannot reach the
threshold of any query of a group is not sent to it, and within a group the
search of a query ends at the first such block.

The query set grows with the table, so a group is one block of queries and one
block of candidates, both of bounded size, and gives at most k rows to a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.llm.common import Workspace
from vegaflow.llm.integer_vectors import as_integers, as_long, exact_in_doubles, packed, unpacked, whole_components

#: Vectors to a packed row; queries and candidates to a group (in the mean); vectors of a dimension that its axes are fitted to (by hash of the id).
PACK, QUERIES, CANDIDATES, SAMPLE = 2048, 65536, 32768, 2048
#: Coordinates of the head; queries at a time; share of pairs in reach from which a dense product is cheaper than single ones.
HEAD, CHUNK, DENSE = 16, 512, 0.05


def rows_of(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """id, dim, body, size (length) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, x in whole_components(b.column(1), scale):
                ids = b.column(0).take(pa.array(at)).cast(pa.int64())
                sizes = np.sqrt((x * x).sum(axis=1))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(at), dim), pa.int32()), pa.array([packed(v) for v in x], pa.binary()), pa.array(sizes)], names=["id", "dim", "body", "size"])

    return vectors.select(id_col, vec_col).where(F.col(id_col).isNotNull()).mapInArrow(run, "id bigint, dim int, body binary, size double")


def whole(bodies: list[bytes], dim: int) -> np.ndarray:
    if len(set(map(len, bodies))) == 1:
        return unpacked(b"".join(bodies), len(bodies), dim)
    return np.concatenate([unpacked(x, 1, dim) for x in bodies])


def packs(rows: DataFrame) -> DataFrame:
    """dim, part, at, n, top (greatest length), ids, body: neighbouring rows of one dimension in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]]) if len(dims) else []
            for lo, hi in zip(edges, [*edges[1:], len(dims)], strict=True):
                for a in range(lo, hi, PACK):
                    own = b.slice(a, min(PACK, hi - a))
                    x = whole(own.column(2).to_pylist(), int(dims[lo]))
                    ids = own.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                    top = float(own.column(3).to_numpy(zero_copy_only=False).max())
                    yield pa.RecordBatch.from_arrays([pa.array([dims[lo]], pa.int32()), pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([top]), pa.array([ids], pa.binary()), pa.array([packed(x)], pa.binary())], names=["dim", "part", "at", "n", "top", "ids", "body"])
                    at += 1

    return rows.mapInArrow(run, "dim int, part int, at int, n int, top double, ids binary, body binary")


def axes_of(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
    """Right singular vectors of a dimension's sample, greatest first."""
    dim = int(key[0])
    x = whole(sample["body"].tolist(), dim)
    axes = np.linalg.svd(x, full_matrices=True)[2].T if dim else np.zeros((0, 0))
    return pd.DataFrame({"dim": [dim], "axes": [axes.astype("<f8").tobytes()]})


def products(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs in reach; minus infinity elsewhere."""
    fits = exact_in_doubles(a.shape[1], a, b)
    if fits and reach.mean() > DENSE:
        return np.where(reach, a @ b.T, -np.inf)
    out = np.full(reach.shape, -np.inf, "f8" if fits else object)
    i, j = np.nonzero(reach)
    if not fits:
        a, b = as_integers(a), as_integers(b)
    for lo in range(0, len(i), 1 << 16):
        p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        out[p, q] = (a[p] * b[q]).sum(axis=1)
    return out


class Search:
    """The best k candidates so far of a block of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, axes: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.x, self.axes, self.least, self.k = ids, x, axes, least.copy(), k
        self.head, self.rest = self.split(x)
        self.size = np.sqrt((x * x).sum(axis=1))
        # rows found so far: number of the query, id, score
        self.found = (np.zeros(0, int), np.zeros(0, "i8"), np.zeros(0, "f8"))
        self.looked = 0

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = x @ self.axes
        return turned[:, :HEAD], np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1))

    def reachable(self, top: float) -> np.ndarray:
        """Queries whose threshold a vector of that length may reach."""
        return np.flatnonzero(self.size * top * (1 + 1e-9) >= self.least)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        head, rest = self.split(x)
        size = np.sqrt((x * x).sum(axis=1))
        live = self.reachable(size.max(initial=0))
        for lo in range(0, len(live), CHUNK):
            q = live[lo : lo + CHUNK]
            bound = self.head[q] @ head.T
            bound += self.rest[q][:, None] * rest
            bound += 1e-9 * self.size[q][:, None] * size
            reach = (bound >= self.least[q][:, None]) & (ids != self.ids[q][:, None])
            self.looked += int(reach.sum())
            score = products(self.x[q], x, reach)
            least = self.least[q].astype(score.dtype)
            if len(ids) >= self.k:
                least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero(reach & (score >= least[:, None]))
            if len(i):
                self.keep(q, q[i], ids[j], score[i, j])

    def keep(self, queries: np.ndarray, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge new rows of some queries with what they have; their thresholds rise to the k-th score."""
        old = self.found
        mine = np.isin(old[0], queries)
        i, ids, score = np.r_[old[0][mine], i], np.r_[old[1][mine], ids], np.r_[old[2][mine], score]
        order = sorted(range(len(i)), key=lambda p: (i[p], -score[p], ids[p])) if score.dtype == object else np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < self.k
        last = place == self.k - 1
        self.least[i[last]] = np.maximum(self.least[i[last]], lower(score[last]))
        self.found = (np.r_[old[0][~mine], i[top]], np.r_[old[1][~mine], ids[top]], np.r_[old[2][~mine], score[top]])

    def best(self) -> pd.DataFrame:
        i, ids, score = self.found
        return pd.DataFrame({"query_id": self.ids[i], "vec_id": ids, "score": as_long(score)})


def lower(score: np.ndarray) -> np.ndarray:
    """Scores as doubles that are not above them."""
    out = score.astype("f8")
    return np.where(np.abs(out) < 2.0**53, out, out - np.abs(out) * 1e-15)


def loaded(ids: bytes, body: bytes, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), unpacked(body, n, dim)


def searched(ids: bytes, body: bytes, n: int, dim: int, axes: bytes, least: bytes | None, k: int) -> Search:
    own, x = loaded(ids, body, n, dim)
    floor = np.frombuffer(least, "<f8") if least is not None else np.full(n, -np.inf)
    return Search(own, x, np.frombuffer(axes, "<f8").reshape(dim, dim), floor, k)


def with_thresholds(queries: DataFrame, k: int) -> DataFrame:
    """Packed queries with the k-th score that each has in the longest block, and the least length a vector needs to matter to any."""
    keep = ["dim", "part", "at", "n", "ids", "body", "axes"]
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                x = {c: row.column(c)[0].as_py() for c in [*keep, "top_ids", "top_body", "top_n"]}
                s = searched(x["ids"], x["body"], x["n"], x["dim"], x["axes"], None, k)
                s.see(*loaded(x["top_ids"], x["top_body"], x["top_n"], x["dim"]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(s.size > 0, s.least / s.size, np.where(s.least > 0, np.inf, -np.inf))
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in keep), pa.array([s.least.astype("<f8").tobytes()], pa.binary()), pa.array([float(need.min())])], names=[*keep, "least", "need"])

    return queries.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "least binary, need double"]))


def group_search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k candidates of a group for each of its queries, longest candidates first."""
    candidates = candidates.sort_values("top", ascending=False)
    out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
    for q in queries.itertuples():
        s = searched(q.ids, q.body, q.n, q.dim, q.axes, q.least, k)
        for c in candidates.itertuples():
            if not len(s.reachable(c.top)):
                break
            s.see(*loaded(c.ids, c.body, c.n, c.dim))
        out.append(s.best())
    return pd.concat([f for f in out if len(f)] or out[:1])


def top_products(spark: SparkSession, vectors: DataFrame, asks: Column | None = None, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every query the k greatest inner products of whole numbers, ties to the smaller id.

    Queries are the rows for which ``asks`` (of the id, named ``id``) holds, by
    default ids divisible by 50; candidates all rows but the query's own. Null
    vectors and ids, and vectors with null or non-finite components, take no part;
    vectors of different length do not meet; those of no length at all have the
    product 0. An id stands for one vector: of several the one of the least
    dimension, then bytes. Components beyond 2^62 are taken as that, scores beyond a long as
    the longest. An empty table gives no rows; other columns are not read.
    """
    work = Workspace(spark, "products")
    rows = rows_of(vectors, scale, id_col, vec_col).groupBy("id").agg(F.min(F.struct("dim", "body", "size")).alias("v")).select("id", "v.*")
    rows = work.save(rows, "rows")
    total = rows.count()
    parts = max(-(-total // CANDIDATES), min(spark.sparkContext.defaultParallelism, -(-total // PACK)), 1)
    dealt = rows.withColumn("short", -F.col("size")).repartitionByRange(parts, "dim", "short", "id").sortWithinPartitions("dim", "short", "id")
    blocks = work.save(packs(dealt.select("id", "dim", "body", "size")), "blocks")
    drawn = Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(7), "id"), "id")
    sample = rows.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= SAMPLE)
    axes = work.save(sample.select("dim", "body").groupBy("dim").applyInPandas(axes_of, "dim int, axes binary"), "axes")
    asked = rows.where((F.col("id") % 50 == 0) if asks is None else asks)
    asked = work.save(packs(asked.select("id", "dim", "body", "size")), "asked")
    groups = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // QUERIES))
    longest = blocks.groupBy("dim").agg(F.max_by(F.struct("ids", "body", "n"), F.struct("top", "n", "part", "at")).alias("t"))
    longest = longest.select("dim", F.col("t.ids").alias("top_ids"), F.col("t.body").alias("top_body"), F.col("t.n").alias("top_n"))
    ready = with_thresholds(asked.drop("top").join(axes, "dim").join(longest, "dim"), k)
    ready = work.save(ready.withColumn("i", F.pmod(F.xxhash64("part", "at"), F.lit(groups)).cast("int")), "ready")
    # which groups meet, from one row of each block
    need = ready.groupBy("dim", "i").agg(F.min("need").alias("need"))
    tops = blocks.groupBy("dim", F.col("part").alias("j")).agg(F.max("top").alias("longest"))
    met = work.save(need.join(tops, "dim").where(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("dim", "i", "j"), "met")
    left = ready.join(met, ["dim", "i"]).select("dim", "i", "j", "n", "ids", "body", "axes", "least")
    right = blocks.withColumnRenamed("part", "j").join(met, ["dim", "j"]).select("dim", "i", "j", "n", "top", "ids", "body")
    found = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInPandas(lambda q, c: group_search(q, c, k), "query_id bigint, vec_id bigint, score bigint")
    found = work.save(found, "found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
