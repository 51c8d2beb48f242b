"""Nearest rows of a stated query set, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors to a packed row; queries and rows to a block (in the mean); queries at a time in a task.
PACK, QUERIES, ROWS, CHUNK = 2048, 16384, 32768, 256


def packs(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """part, at, n, ids, body: vectors of unit length (zero stays zero), many to a row; null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, PACK):
                own = b.slice(lo, PACK)
                x = own.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                size = np.sqrt((x * x).sum(axis=1, keepdims=True))
                ids = own.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                unit = (x / np.where(size > 0, size, 1)).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([own.num_rows], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary())], names=["part", "at", "n", "ids", "body"])
                at += 1

    return df.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInArrow(run, "part int, at int, n int, ids binary, body binary")


def best_of(queries: pd.DataFrame, rows: pd.DataFrame, k: int, floor: float) -> pd.DataFrame:
    """The best ``k`` rows of one block for each query of another."""
    out = [pd.DataFrame({"query_id": np.zeros(0, "i8"), "id": np.zeros(0, "i8"), "similarity": np.zeros(0)})]
    for q in queries.itertuples():
        names, asked = np.frombuffer(q.ids, "<i8"), np.frombuffer(q.body, "<f8").reshape(q.n, -1)
        for lo in range(0, q.n, CHUNK):
            best = out[0]
            for r in rows.itertuples():
                ids, x = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.body, "<f8").reshape(r.n, -1)
                sims = asked[lo : lo + CHUNK] @ x.T
                i, j = np.nonzero((sims >= floor) & (names[lo : lo + CHUNK, None] != ids))
                new = pd.DataFrame({"query_id": names[lo + i], "id": ids[j], "similarity": sims[i, j]})
                best = pd.concat([best, new]) if len(best) else new
                best = best.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if len(best):
                out.append(best)
    return pd.concat(out[1:]) if len(out) > 1 else out[0]


def nearest_rows(rows: DataFrame, queries: DataFrame, k: int, floor: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, id, similarity, place: the ``k`` rows nearest to each query by cosine, at or above ``floor``.

    A row is never its own answer; ties go to the smaller id. Both sides are
    packed into blocks of bounded size, and every block of queries meets every
    block of rows in a task of its own, which gives at most ``k`` rows a query.
    Neither the plan nor the driver grows with the number of queries. Null
    vectors are left out. All vectors have one length.
    """
    asked, held = packs(queries, id_col, vec_col), packs(rows, id_col, vec_col)
    n_queries, n_rows = (df.where(F.col(vec_col).isNotNull()).count() for df in (queries, rows))
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    i, j = max(1, -(-n_queries // QUERIES)), max(1, -(-n_rows // ROWS), min(tasks, -(-n_rows // PACK)))
    place = lambda n: F.pmod(F.xxhash64("part", "at"), F.lit(n)).cast("int")
    left = asked.withColumn("i", place(i)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(j - 1))))
    right = held.withColumn("j", place(j)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(i - 1))))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(lambda q, r: best_of(q, r, k, floor), "query_id bigint, id bigint, similarity double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", order).where(F.col("place") <= k)
