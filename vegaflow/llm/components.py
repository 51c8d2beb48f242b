"""Connected components of an edge table by alternating large and small stars.

Each round links every node to the least id it sees. Minima are aggregated per
node and written before they are joined back: the join is then one of plain
shuffles, so that the edges of a node with very many of them are split over
tasks, and nothing about a node is ever collected. Each round is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vegaflow.llm.common import Workspace


def _star(work: Workspace, edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Edges (a, b), a < b. Large: link a node's larger neighbours to its least; small: link its smaller one and itself."""
    if large:
        least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        # a node without a smaller neighbour is its own least, and its edges stay as they are
        least = work.save(least, f"{name}-least")
        linked = edges.withColumnRenamed("a", "u").join(least, "u", "left")
        return linked.select(F.coalesce("m", "u").alias("a"), "b").where("a <> b").distinct()
    least = work.save(edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), f"{name}-least")
    linked = edges.withColumnRenamed("b", "u").join(least, "u")
    out = linked.select(F.col("a").alias("v"), "m").unionAll(least.select(F.col("u").alias("v"), "m"))
    return out.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(work: Workspace, edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(id, component): every node of ``edges`` (columns a, b; a < b) with the least id it can reach."""
    now = work.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    mark = None
    for i in range(1, rounds + 1):
        wide = work.save(_star(work, now, True, f"{name}-{i}a"), f"{name}-{i}a")
        nxt = work.save(_star(work, wide, False, f"{name}-{i}b"), f"{name}-{i}")
        for old in (f"{name}-{i - 1}", f"{name}-{i}a", f"{name}-{i}a-least", f"{name}-{i}b-least"):
            work.drop(old)
        now = nxt
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ids = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return ids.unionAll(now.select("a", "a").distinct().toDF("id", "component"))
