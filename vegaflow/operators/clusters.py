"""k-means of sliding windows as distributions: packed rows of sorted samples, rounds of partial sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.session import shared_folder

#: Windows to a packed row.
PACK = 1024


def sorted_windows(series: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """key, i (from 0), q: each window of ``width`` values, sorted; that is its quantile function."""
    w = Window.partitionBy(key).orderBy(order)
    x = series.select(key, order, F.collect_list(value).over(w.rowsBetween(1 - width, 0)).alias("q"), F.row_number().over(w).alias("i"))
    return x.where(F.size("q") == width).select(key, (F.col("i") - width).alias("i"), F.array_sort("q").alias("q"))


def squares(q: pa.ListScalar, centres: pa.ListScalar, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, mean squared differences to the centres), the squared distances of the distributions."""
    x = q.values.to_numpy().reshape(-1, width)
    c = centres.values.to_numpy().reshape(-1, width)
    return x, ((x[:, None] - c) ** 2).mean(axis=2)


def over_packs(packs: DataFrame, centres: DataFrame, key: str, width: int, rows_of, columns: str) -> DataFrame:
    """``rows_of(windows, squared distances)`` -> columns, for every packed row with its key's centres."""
    kind = packs.schema[key].dataType.simpleString()
    names = [key, "first", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = rows_of(*squares(b.column(2)[i], b.column(3)[i], width))
                n = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n, b.schema.field(0).type), pa.array(np.full(n, b.column(1)[i].as_py()), pa.int64()), *map(pa.array, found)], names=names)

    return packs.join(centres, key).select(key, "first", "q", "centres").mapInArrow(run, f"{key} {kind}, first bigint, {columns}")


def seeds(packs: DataFrame, counts: DataFrame, key: str, width: int, draws: Sequence[float]) -> DataFrame:
    """key, centres: the first by place, each other with the chance of its distance to the nearest so far; ``draws`` are the random numbers."""
    at = F.floor(F.lit(draws[0]) * F.col("n"))
    own = lambda i: F.slice("q", (i - F.col("first")).cast("int") * width + 1, F.lit(width))
    inside = lambda i: (i >= F.col("first")) & (i < F.col("first") + F.size("q") / width)
    centres = packs.join(counts, key).where(inside(at)).select(key, own(at).alias("centres"))
    for draw in draws[1:]:
        d = over_packs(packs, centres, key, width, lambda x, d: [np.arange(len(x)), d.min(axis=1)], "at bigint, d double")
        w = Window.partitionBy(key)
        d = d.withColumn("i", F.col("first") + F.col("at")).withColumns({"sum": F.sum("d").over(w.orderBy("i")), "all": F.sum("d").over(w)})
        drawn = d.where(F.col("sum") > F.lit(draw) * F.col("all")).groupBy(key).agg(F.min("i").alias("drawn"))
        centres = packs.join(drawn, key).where(inside(F.col("drawn"))).join(centres, key).select(key, F.concat("centres", own(F.col("drawn"))).alias("centres"))
    return centres


def sums(x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    """cluster, place, sum and number of the windows of each cluster."""
    near = d.argmin(axis=1)
    found, width = np.unique(near), x.shape[1]
    total = np.concatenate([x[near == c].sum(axis=0) for c in found])
    return [np.repeat(found, width), np.tile(np.arange(width), len(found)), total, np.repeat(np.bincount(near)[found], width)]


def window_clusters(spark: SparkSession, series: DataFrame, key: str, order: str, value: str, width: int, draws: Sequence[float], rounds: int = 50, tol: float = 1e-5) -> DataFrame:
    """key, cluster (0 the calmest), sd, share, now (cluster of the last window) of the k-means of every key's windows.

    Windows lie packed in rows of bounded size, so a key's windows are spread over
    tasks; a round gives one sum per packed row, cluster and place, and these are
    aggregated. Windows, seeds and the centres of each round are written to the
    shared folder. The rounds end when no centre of any key moves by more than a
    share ``tol`` of itself.
    """
    root, k = shared_folder(spark, "clusters"), len(draws)

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    windows = sorted_windows(series, key, order, value, width).withColumn("pack", F.floor(F.col("i") / PACK))
    rows = F.array_sort(F.collect_list(F.struct("i", "q")))
    packs = saved(windows.groupBy(key, "pack").agg(F.min("i").alias("first"), F.flatten(rows["q"]).alias("q")).drop("pack"), "windows")
    counts = saved(packs.groupBy(key).agg(F.sum(F.size("q") / width).cast("long").alias("n")), "counts")
    places = F.posexplode("centres").alias("p", "m")
    now = saved(seeds(packs, counts, key, width, draws).select(key, places), "seeds")
    joined_up = lambda rows: rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("centres"))
    for r in range(rounds):
        found = over_packs(packs, joined_up(now), key, width, sums, "c bigint, at bigint, s double, n bigint")
        means = found.groupBy(key, (F.col("c") * width + F.col("at")).cast("int").alias("p")).agg((F.sum("s") / F.sum("n")).alias("new"))
        new = saved(now.join(means, [key, "p"], "left").select(key, "p", F.coalesce("new", "m").alias("m"), (F.abs(F.coalesce("new", "m") - F.col("m")) - tol * F.abs("m")).alias("step")), f"round-{r}")
        now = new.select(key, "p", "m")
        if (new.agg(F.max("step")).first()[0] or 0.0) <= 1e-8:
            break
    centres = saved(joined_up(now), "centres")
    near = saved(over_packs(packs, centres, key, width, lambda x, d: [np.arange(len(x)), d.argmin(axis=1)], "at bigint, c bigint").select(key, (F.col("first") + F.col("at")).alias("i"), "c"), "near")
    last = near.groupBy(key).agg(F.max_by("c", "i").alias("last"))
    sizes = near.groupBy(key, "c").agg(F.count("*").alias("members"))
    spread = now.groupBy(key, F.floor(F.col("p") / width).alias("c")).agg(F.stddev_pop("m").alias("sd"))
    ranked = spread.withColumn("cluster", F.row_number().over(Window.partitionBy(key).orderBy("sd", "c")) - 1)
    alive = last.join(ranked.select(key, F.col("c").alias("last"), F.col("cluster").alias("now")), [key, "last"]).select(key, "now")
    out = ranked.join(sizes, [key, "c"], "left").join(counts, key).join(alive, key)
    return out.select(key, "cluster", "sd", (F.coalesce("members", F.lit(0)) / F.col("n")).alias("share"), "now")
