"""Product codes of vectors by k-means whose bounds live in heaps: exact Lloyd rounds that look at few parts.

A vector is cut into parts; each part position has a codebook. Vectors lie in
blocks, and a block keeps, for each entry of each codebook, a heap of the parts
assigned to it. The key of a part is the slack between the distance to its
nearest other entry and that to its own, plus the drift the entry had gathered
when the part was looked at. As entries move, an entry gathers its own drift and
the largest of any other; while the least key of its heap is not above that sum,
the part is popped and measured against all entries again. All others stay, by
the triangle inequality.

A round is one pass of Spark over the blocks: blocks and the changes of sums that
moved parts bring, added up per task, are written together; sums meet in one
aggregation and only the codebooks (entries x dimension) reach the driver. Bodies
are never shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vegaflow.llm.common import Workspace
from vegaflow.llm.integer_vectors import MOST, as_integers, as_long, exact_in_doubles, packed, unpacked, whole_components

#: Vectors to a block.
BLOCK = 2048


def blocks_of(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """dim, ids, labels, body: vectors as whole numbers in blocks of one dimension."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, x in whole_components(b.column(1), scale):
                for lo in range(0, len(at), BLOCK):
                    rows = pa.array(at[lo : lo + BLOCK])
                    ids, labels = b.column(0).take(rows), b.column(2).take(rows)
                    cut = pa.array([0, len(rows)], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.ListArray.from_arrays(cut, ids), pa.ListArray.from_arrays(cut, labels), pa.array([packed(x[lo : lo + BLOCK])], pa.binary())], names=["dim", "ids", "labels", "body"])

    return vectors.select(id_col, vec_col, label_col).mapInArrow(run, f"dim int, ids array<{kinds[id_col]}>, labels array<{kinds[label_col]}>, body binary")


def first_vectors(blocks: DataFrame, entries: int) -> list[np.ndarray]:
    """The vectors of the smallest ids, ascending; of one id the least by length, then components. Each task gives as many at most."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        for b in batches:
            for i in range(b.num_rows):
                dim, ids = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                x = unpacked(b.column(2)[i].as_py(), len(ids), dim)
                for j in sorted((j for j, v in enumerate(ids) if v is not None), key=ids.__getitem__):
                    if ids[j] not in least and len(least) >= entries and ids[j] > max(least):
                        break
                    least[ids[j]] = min(least.get(ids[j], (dim, x[j].tolist())), (dim, x[j].tolist()))
                least = {k: least[k] for k in sorted(least)[:entries]}
        if least:
            yield pa.RecordBatch.from_arrays([pa.array(list(least)), pa.array([d for d, _ in least.values()], pa.int32()), pa.array([v for _, v in least.values()], pa.list_(pa.float64()))], names=["id", "dim", "x"])

    found = blocks.select("dim", "ids", "body").mapInArrow(run, f"id {kind}, dim int, x array<double>")
    rows = found.groupBy("id").agg(F.min(F.struct("dim", "x")).alias("v")).orderBy("id").limit(entries).collect()
    return [np.array(r["v"]["x"], "f8") for r in rows]


class Book:
    """Codebooks of all part positions with the drift that each entry has gathered."""

    def __init__(self, firsts: list[np.ndarray], parts: int):
        self.dim = len(firsts[0])
        self.cuts = [self.dim * p // parts for p in range(parts + 1)]
        table = np.array([x for x in firsts if len(x) == self.dim], "f8").reshape(-1, self.dim)
        self.entries = [table[:, lo:hi] for lo, hi in zip(self.cuts, self.cuts[1:])]
        self.drift = [np.zeros(len(table)) for _ in range(parts)]

    def moved(self, entries: list[np.ndarray]) -> None:
        for p, new in enumerate(entries):
            own = np.sqrt(((new - self.entries[p]) ** 2).sum(axis=1))
            order = np.argsort(-own, kind="stable")
            other = np.full(len(own), own[order[0]])
            other[order[0]] = own[order[1]] if len(own) > 1 else 0.0
            self.drift[p] = self.drift[p] + own + other
        self.entries = entries

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    if exact_in_doubles(x.shape[1], x, entries):
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    e, out = as_integers(entries), np.empty((len(x), len(entries)), object)
    for i, row in enumerate(as_integers(x)):
        out[i] = ((row - e) ** 2).sum(axis=1)
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, slack): the nearest entry, ties to the lower index, and how much farther the next one is."""
    d = squares(x, entries)
    best = d.argmin(axis=1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], int)
    near = d[np.arange(len(x)), best].astype("f8")
    if d.shape[1] == 1:
        return best, np.full(len(x), np.inf)
    d[np.arange(len(x)), best] = np.inf
    return best, np.sqrt(d.min(axis=1).astype("f8")) - np.sqrt(near)


class Heaps:
    """The parts of one block at one position: for each entry a heap of (key, part), stored as arrays in heap order."""

    def __init__(self, ends: np.ndarray, order: np.ndarray, keys: np.ndarray):
        self.ends, self.order, self.keys = ends, order, keys

    @classmethod
    def build(cls, code: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((keys, code))  # a sorted list is a heap
        return cls(np.searchsorted(code[order], np.arange(entries), "right").astype("<i4"), order.astype("<i2"), keys[order])

    @classmethod
    def read(cls, state: bytes, n: int, entries: int) -> Heaps:
        a, b = 4 * entries, 4 * entries + 2 * n
        return cls(np.frombuffer(state[:a], "<i4"), np.frombuffer(state[a:b], "<i2"), np.frombuffer(state[b:], "<f8"))

    def write(self) -> bytes:
        return self.ends.astype("<i4").tobytes() + self.order.astype("<i2").tobytes() + self.keys.astype("<f8").tobytes()

    def codes(self) -> np.ndarray:
        code = np.empty(len(self.order), np.int64)
        code[self.order] = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        return code

    def settle(self, x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray, np.ndarray]:
        """Pop and measure the parts whose bounds no longer hold: (heaps, parts that moved, their old entries, their new ones)."""
        starts = np.r_[0, self.ends[:-1]]
        # rounding of the bounds, many times over; a part popped in vain is measured exactly
        bound = drift + 1e-9 * (drift + np.abs(x).max(initial=0) * max(1, x.shape[1]) + 1)
        full = np.flatnonzero(self.ends > starts)
        if not (self.keys[starts[full]] <= bound[full]).any():
            none = np.zeros(0, int)
            return self, none, none, none
        heaps = [list(zip(self.keys[a:b].tolist(), self.order[a:b].tolist(), strict=True)) for a, b in zip(starts, self.ends, strict=True)]
        popped, old = [], []
        for c, heap in enumerate(heaps):
            while heap and heap[0][0] <= bound[c]:
                popped.append(heapq.heappop(heap)[1])
                old.append(c)
        rows, old = np.array(popped, int), np.array(old, int)
        new, slack = nearest(x[rows], entries)
        for row, c, key in zip(popped, new.tolist(), (slack + drift[new]).tolist(), strict=True):
            heapq.heappush(heaps[c], (key, row))
        flat = [e for heap in heaps for e in heap]
        ends = np.cumsum([len(h) for h in heaps])
        left = new != old
        return Heaps(ends, np.array([r for _, r in flat]), np.array([k for k, _ in flat])), rows[left], old[left], new[left]


class Changes:
    """Sums and counts that parts bring to entries, and take from them."""

    def __init__(self) -> None:
        self.sums: dict[tuple[int, int], np.ndarray | int] = defaultdict(int)
        self.counts: dict[tuple[int, int], int] = defaultdict(int)

    def add(self, part: int, code: np.ndarray, x: np.ndarray, sign: int) -> None:
        if not len(code):
            return
        big = not exact_in_doubles(len(x), x, np.ones(1))
        order = np.argsort(code, kind="stable")
        found, starts = np.unique(code[order], return_index=True)
        rows = as_integers(x[order]) if big else x[order].astype(np.int64)
        for c, total, n in zip(found.tolist(), np.add.reduceat(rows, starts, axis=0), np.diff(np.r_[starts, len(code)]).tolist(), strict=True):
            self.sums[part, c] = self.sums[part, c] + sign * (total if big else total.astype(object))
            self.counts[part, c] += sign * n

    def columns(self) -> list[pa.Array]:
        keys = list(self.sums)
        sums = [[Decimal(int(v)) for v in self.sums[k]] for k in keys]
        return [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([self.counts[k] for k in keys], pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))]


def pass_over(blocks: DataFrame, book: Book, first: bool) -> DataFrame:
    """Blocks with their heaps after one assignment, and rows of changes (part not null), added up per task."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    parts, entries = len(book.entries), len(book.entries[0])
    schema = f"ids {kinds['ids']}, labels {kinds['labels']}, body binary, state array<binary>, part int, entry int, n bigint, sums array<decimal(38,0)>"
    names = ["ids", "labels", "body", "state", "part", "entry", "n", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes, kept = Changes(), None
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                n = len(b.column(0)[0])
                x = unpacked(b.column(2)[0].as_py(), n, book.dim)
                states = []
                for p in range(parts):
                    own = x[:, book.cuts[p] : book.cuts[p + 1]]
                    if first:
                        code, slack = nearest(own, book.entries[p])
                        heaps = Heaps.build(code, slack + book.drift[p][code], entries)
                        changes.add(p, code, own, 1)
                    else:
                        heaps, rows, old, new = Heaps.read(b.column(3)[0][p].as_py(), n, entries).settle(own, book.entries[p], book.drift[p])
                        changes.add(p, old, own[rows], -1)
                        changes.add(p, new, own[rows], 1)
                    states.append(heaps.write())
                kept = [b.column(c).type for c in (0, 1, 2)]
                none = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([states], pa.list_(pa.binary())), *none], names=names)
        if kept and changes.sums:
            cols = changes.columns()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(cols[0]), t) for t in [*kept, pa.list_(pa.binary())]), *cols], names=names)

    columns = ["ids", "labels", "body", *([] if first else ["state"])]
    return blocks.select(*columns).mapInArrow(run, schema)


def coded(blocks: DataFrame, book: Book) -> DataFrame:
    """id, label, code (hex digits of the entries by part), error (squared distances of all parts to their entries)."""
    kinds = {c: blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")}
    parts, entries = len(book.entries), len(book.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                n = len(b.column(0)[0])
                x = unpacked(b.column(2)[0].as_py(), n, book.dim)
                codes = np.empty((n, parts), "u1")
                error: np.ndarray | int = 0
                for p in range(parts):
                    code = Heaps.read(b.column(3)[0][p].as_py(), n, entries).codes()
                    own, near = x[:, book.cuts[p] : book.cuts[p + 1]], book.entries[p][code]
                    plain = exact_in_doubles(book.dim, own, near)
                    gap = own - near if plain else as_integers(own) - as_integers(near)
                    square = (gap * gap).sum(axis=1)
                    error = error + (square.astype(np.int64) if plain else square)
                    codes[:, p] = code
                yield pa.RecordBatch.from_arrays([b.column(0).flatten(), b.column(1).flatten(), pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(as_long(np.asarray(error)), pa.int64())], names=["id", "label", "code", "error"])

    return blocks.select("ids", "labels", "body", "state").mapInArrow(run, f"id {kinds['ids']}, label {kinds['labels']}, code string, error bigint")


def product_codes(spark: SparkSession, vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector that is not null and holds finite numbers only: id, code, error, label_error, codebooks_sha256.

    Codebooks start from the smallest ids (null ids are no start; of an id with
    several vectors the least counts; entries of large numbers are rounded to doubles)
    and have the dimension of the first; vectors
    of another dimension have a null code and error and bring nothing. A dimension
    that the number of parts does not divide is cut at floor(dimension * i / parts).
    Equal rows are rows of their own. Components beyond 2^62 are taken as that, sums
    beyond a long as the longest. An empty table gives no rows; other columns are
    not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte to a part: 1 to 256 entries")
    work = Workspace(spark, "codes")
    blocks = work.save(blocks_of(vectors, scale, id_col, vec_col, label_col), "blocks")
    firsts = first_vectors(blocks, entries)
    if not firsts:
        none = F.lit(None)
        rows = blocks.select(F.explode(F.arrays_zip("ids", "labels")).alias("r")).select(F.col("r.ids").alias(id_col))
        return rows.select(id_col, none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), none.cast("string").alias("codebooks_sha256"))
    book = Book(firsts, parts)
    sums = [[[0] * e.shape[1] for _ in e] for e in book.entries]
    counts = [[0] * len(e) for e in book.entries]
    now = blocks.where(F.col("dim") == book.dim)
    for r in range(rounds + 1):
        done = work.save(pass_over(now, book, r == 0), f"round-{r}")
        if r:
            work.drop(f"round-{r - 1}")
        now = done.where("part is null")
        if r == rounds:
            break
        changed = done.where("part is not null")
        # of bounded size: entries x dimension, and entries
        for x in changed.select("part", "entry", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("v").alias("v")).collect():
            sums[x["part"]][x["entry"]][x["at"]] += int(x["v"])
        for x in changed.groupBy("part", "entry").agg(F.sum("n").alias("n")).collect():
            counts[x["part"]][x["entry"]] += x["n"]
        book.moved([np.array([[v // n for v in s] if n else old for s, n, old in zip(sums[p], counts[p], e.tolist(), strict=True)], "f8").reshape(e.shape) for p, e in enumerate(book.entries)])
    known = work.save(coded(now, book), "coded")
    totals = known.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(MOST))).cast("long").alias("label_error"))
    totals = work.save(totals.withColumnRenamed("label", "of"), "totals")
    rows = known.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
    none = F.lit(None)
    other = blocks.where(F.col("dim") != book.dim).select(F.explode("ids").alias(id_col))
    return rows.unionAll(other.select(id_col, none.cast("string"), none.cast("long"), none.cast("long"), F.lit(book.digest())))
