"""Shared helpers: tables, written intermediates, and byte views of Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Intermediate tables written to the folder all executors share.

    A written table cuts the lineage, so a lost executor costs only the tasks
    that read it. The folder is ``spark.checkpoint.dir`` of the session. Where
    that is unset, a local session makes a folder of this machine; on a cluster,
    whose executors could not share it, that is an error.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.getCheckpointDir():
                if not spark.conf.get("spark.master", "local").startswith("local"):
                    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
                spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vegaflow-"))
            base = spark.sparkContext.getCheckpointDir()
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", compression).parquet(path)
        self._release()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _release(self) -> None:
        """Let Spark's cleaner drop the shuffle files of jobs that have ended."""
        self.spark._jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1: rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def byte_views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the UTF-8 bytes of a string column and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, "<i8", count=len(column) + 1 + column.offset)[column.offset :]
    flat = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return flat[starts[0] : starts[-1]], starts - starts[0]


def byte_slices(sizes: np.ndarray, limit: int):
    """Row ranges of at most ``limit`` bytes each (one row at least)."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, hi
        lo = hi


def text_slices(batch: pa.RecordBatch, column: int, limit: int):
    """Parts of a batch with at most ``limit`` bytes of the text column each, so that no task holds a whole batch as objects."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    for lo, hi in byte_slices(sizes, limit):
        yield batch.slice(lo, hi - lo)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (in place where it can)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc32_u32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
