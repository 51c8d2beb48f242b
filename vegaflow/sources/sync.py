"""Chunks kept in step with their sources: a table of versions that a run adds to only where something changed.

The table is a folder of versions, ``full-<n>`` and ``delta-<n>``; a delta holds
the chunks that came or changed and marks for those that went. What is stored
now is, for each (source, place), the row of the highest version since the last
full one. A version counts once Spark has finished it, so a failed run leaves
the table as it was and is run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["source", "chunk_index"]
COLUMNS = "source string, chunk_index int, content string, content_hash string, gone boolean"
#: Deltas after which a full version is written.
MOST_DELTAS = 20


@dataclass(frozen=True)
class Report:
    version: int
    upserted: int
    unchanged: int
    orphans: int
    retired: int


def versions(spark: SparkSession, path: str) -> list[str]:
    """Finished versions that count: from the last full one on, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    names = sorted((n for n in names if n.startswith(("full-", "delta-"))), key=lambda n: int(n.split("-")[1]))
    full = [i for i, n in enumerate(names) if n.startswith("full-")]
    return names[full[-1] :] if full else names


def number(name: str) -> int:
    return int(name.split("-")[1])


def stored(spark: SparkSession, path: str, columns: Sequence[str] = ("content", "content_hash")) -> DataFrame:
    """source, chunk_index and ``columns`` as of the last version."""
    rows = None
    for name in versions(spark, path):
        one = spark.read.schema(COLUMNS).parquet(f"{path}/{name}").withColumn("v", F.lit(number(name)))
        rows = one if rows is None else rows.unionAll(one)
    if rows is None:
        return spark.createDataFrame([], COLUMNS).select(*KEY, *columns)
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*columns, "gone"), "v").alias("r"))
    return last.where("not r.gone").select(*KEY, *(F.col(f"r.{c}") for c in columns))


def changes(spark: SparkSession, path: str, new: DataFrame, sources: DataFrame | None) -> DataFrame:
    """source, chunk_index, what: what becomes of every chunk of ``new`` or of the table. Places and hashes are joined, never contents."""
    held = stored(spark, path, ["content_hash"]).select(*KEY, F.unhex("content_hash").alias("held"))
    both = new.select(*KEY, F.unhex("content_hash").alias("now")).join(held, KEY, "full_outer")
    both = both.select(*KEY, F.col("held").isNotNull().alias("known"), F.when(F.col("now").isNotNull(), F.col("held").eqNullSafe(F.col("now"))).alias("same"))
    ends = new.select("source", (F.col("chunk_index") + 1).alias("length"), F.lit(sources is None).alias("listed"))
    if sources is not None:
        ends = ends.unionAll(sources.select(F.col("source").cast("string"), F.lit(None).cast("int"), F.lit(True)))
    state = both.join(ends.groupBy("source").agg(F.max("length").alias("length"), F.bool_or("listed").alias("listed")), "source", "left")
    listed = F.lit(True) if sources is None else F.coalesce("listed", F.lit(False))
    what = (
        F.when(~listed & F.col("known"), "retired")
        .when(~listed, "ignored")
        .when(F.col("same"), "unchanged")
        .when(~F.col("same"), "upserted")
        .when(F.col("chunk_index") >= F.col("length"), "orphans")
        .otherwise("kept")
    )
    return state.select(*KEY, what.alias("what"))


def sync_chunks(spark: SparkSession, path: str, chunks: DataFrame, sources: DataFrame | None = None) -> Report:
    """Bring the table at ``path`` in step with ``chunks`` (source, chunk_index, content).

    Chunks whose hash is stored are left alone. Of a source with fewer chunks than
    before, those past its end go; a source without any chunk keeps what it has,
    as it may have failed to load. With ``sources`` (source), chunks of sources
    that are not listed go. A run that changes nothing writes nothing.

    The first load is written as it is read; later runs shuffle contents once, to
    find those of the chunks that came or changed.
    """
    new = chunks.select(F.col("source").cast("string").alias("source"), F.col("chunk_index").cast("int").alias("chunk_index"), "content", F.sha2("content", 256).alias("content_hash"))
    done = versions(spark, path)
    version = number(done[-1]) if done else 0
    if not done and sources is None:
        rows = new.where("content_hash is not null").withColumn("gone", F.lit(False))
        if rows.isEmpty():
            return Report(version, 0, 0, 0, 0)
        rows.write.mode("overwrite").parquet(f"{path}/delta-1")
        return Report(1, spark.read.schema(COLUMNS).parquet(f"{path}/delta-1").count(), 0, 0, 0)
    state = changes(spark, path, new, sources).persist()
    count = {r["what"]: r["count"] for r in state.groupBy("what").count().collect()}
    changed = sum(count.get(w, 0) for w in ("upserted", "orphans", "retired"))
    if changed:
        version += 1
        came = state.where("what = 'upserted'").toDF("s", "i", "what").hint("merge")  # one plan at every size: what changed grows with the table
        came = new.join(came, F.col("source").eqNullSafe(F.col("s")) & F.col("chunk_index").eqNullSafe(F.col("i")), "left_semi").withColumn("gone", F.lit(False))
        went = state.where("what in ('orphans', 'retired')").select(*KEY, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(True))
        came.unionAll(went).write.mode("overwrite").parquet(f"{path}/delta-{version}")
        if len(done) >= MOST_DELTAS:
            version += 1
            stored(spark, path).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{path}/full-{version}")
    state.unpersist()
    return Report(version, *(count.get(w, 0) for w in ("upserted", "unchanged", "orphans", "retired")))
