"""Sequence packing by non-negative least squares over the length histogram.

Documents become token ids; whole windows are cut off the front and the rest of
each document, its tail, is shorter than a window. All shallow combinations of
tail lengths that fill a window exactly (one, two or three lengths) are columns
of a matrix; non-negative least squares finds how often to repeat each so that
the lengths used match the histogram. Repeats are rounded down, so no length is
used more often than it occurs. The residual tails are packed greedily, longest
first, each window filled to the end by cutting the tail that straddles it. What
is left at the very end fills sequences whose lengths are powers of two.

The histogram has at most ``window`` rows, whatever the input; the solution is a
list of slots (length, first rank, count, sequence, offset). Tails are ranked
within their length by buckets of a hash, so a length that a third of all
documents share is ranked by many tasks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.llm.common import Workspace, crc32_u32

#: Rows to a ranking bucket, about; the number of buckets grows with the rows.
BUCKET_ROWS = 50_000
#: Share of the residual's square that a round of the least squares must remove for another to follow.
LEAST_GAIN = 1e-5
#: Texts wholly of these characters are encoded by the faster of two libraries with the same vocabulary.
PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]")

_ENCODERS: dict[tuple, "Encoder"] = {}


class Encoder:
    """Ids of a byte-level BPE as the tokenizers library gives them, without added tokens.

    Where ``ranks_path`` holds the same vocabulary as ranks, plain texts without
    special strings are encoded from it, with equal ids; all others go through
    the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        if self.fast and not PLAIN.search(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    @classmethod
    def of(cls, *args) -> Encoder:
        if args not in _ENCODERS:
            _ENCODERS[args] = cls(*args)
        return _ENCODERS[args]


def combinations(window: int) -> np.ndarray:
    """(n, 3) lengths a >= b >= c >= 0 with a + b + c = window and a < window."""
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    keep = (c >= 0) & (a >= b) & (b >= c)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def nnls_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 200, block: int = 64) -> np.ndarray:
    """x >= 0 minimising |A x - histogram|, A the lengths that each combination uses.

    Active sets in the manner of Lawson and Hanson, but adding a block of columns
    with pairwise disjoint lengths each round; the passive system stays small, as
    it has at most as many columns as there are lengths.
    """
    n, window = len(combos), len(histogram)
    scale = max(1.0, histogram.max())
    b = histogram / scale
    x, passive = np.zeros(n), np.zeros(0, np.int64)
    residual = b.copy()
    padded = np.where(combos > 0, combos, 0)

    def used_lengths(which: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """A x: how many of each length the repeats use."""
        lengths = padded[which]
        return np.bincount(lengths.ravel(), np.where(lengths > 0, repeats[:, None], 0.0).ravel(), window)

    def gram(which: np.ndarray) -> np.ndarray:
        """A'A: how many lengths two columns share, each as often as both use it."""
        lengths = padded[which]
        out = np.zeros((len(which), len(which)))
        for i in range(3):
            for j in range(3):
                out += (lengths[:, i, None] == lengths[None, :, j]) & (lengths[:, i, None] > 0)
        return out

    for _ in range(rounds):
        gain = sum(np.where(padded[:, k] > 0, residual[padded[:, k]], 0.0) for k in range(3))
        gain[passive] = 0
        order = np.argpartition(-gain, min(n - 1, 4096))[:4096]
        order = order[np.argsort(-gain[order], kind="stable")]
        taken, chosen = np.zeros(window, bool), []
        for j in order:
            if gain[j] * scale < 1 or len(chosen) == block:  # its repeats would be rounded to none
                break
            used = padded[j][padded[j] > 0]
            if not taken[used].any():
                taken[used] = True
                chosen.append(j)
        if not chosen:
            break
        passive = np.concatenate([passive, np.array(chosen, np.int64)])
        while len(passive):
            lengths = padded[passive]
            z = np.linalg.solve(gram(passive) + 1e-9 * np.eye(len(passive)), np.where(lengths > 0, b[lengths], 0.0).sum(axis=1))
            if (z > 0).all():
                x[passive] = z
                break
            now, bad = x[passive], z <= 0
            step = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-300))
            now = now + step * (z - now)
            x[passive] = now
            gone = (now <= 1e-12) & bad
            if not gone.any():
                gone = bad & (now == now[bad].min())
            x[passive[gone]] = 0
            passive = passive[~gone]
        before = float(residual @ residual)
        residual = b - used_lengths(passive, x[passive])
        if before - float(residual @ residual) <= LEAST_GAIN * before:
            break
    return x * scale


def solve_slots(histogram: np.ndarray, window: int) -> dict[str, np.ndarray | int]:
    """Slots of the packed tails and where the residual tails lie in the stream that is cut into windows.

    ``histogram[l]`` is the number of tails of length l < window. Slots are
    arrays sorted by (length, first rank); residual tails of length l are those
    ranked ``used[l]`` and above, at stream position ``base[l] + (rank - used[l]) * l``.
    """
    used = np.zeros(window, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    if histogram.sum():
        combos = combinations(window)
        combos = combos[((combos == 0) | (histogram[combos] > 0)).all(axis=1)]
        if len(combos):
            x = np.floor(nnls_counts(combos, histogram.astype(float)) + 1e-6).astype(np.int64)
            for j in np.argsort(-x, kind="stable"):
                lengths = [int(v) for v in combos[j] if v]
                need = {v: lengths.count(v) for v in lengths}
                repeats = min(int(x[j]), *(int(histogram[v] - used[v]) // k for v, k in need.items()))
                if repeats <= 0:
                    continue
                offset = 0
                for v in lengths:
                    slots.append((v, int(used[v]), repeats, sequences, offset))
                    used[v] += repeats
                    offset += v
                sequences += repeats
    left = histogram - used
    base = np.zeros(window, np.int64)
    stream = 0
    for v in range(window - 1, 0, -1):  # longest first
        base[v] = stream
        stream += int(left[v]) * v
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return {"slots": table, "used": used, "base": base, "stream": stream, "sequences": sequences}


def tail_pieces(plan: dict, window: int, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start in the tail, length, sequence, offset) of the tail's pieces."""
    if rank < plan["used"][length]:
        lo, hi = plan["bounds"][length], plan["bounds"][length + 1]
        i = lo + int(np.searchsorted(plan["slots"][lo:hi, 1], rank, "right")) - 1
        _, first, _, sequence, offset = plan["slots"][i]
        return [(0, length, int(sequence + rank - first), int(offset))]
    out, start = [], 0
    at = int(plan["base"][length] + (rank - plan["used"][length]) * length)
    whole = plan["stream"] // window * window
    while start < length:
        if at < whole:
            room, sequence, offset = window - at % window, plan["sequences"] + at // window, at % window
        else:  # the last tokens of all fill sequences of a power of two
            sequence, begin, rest = plan["sequences"] + whole // window, whole, plan["stream"] - whole
            while True:
                part = 1 << (rest.bit_length() - 1)
                if at < begin + part:
                    break
                begin, rest, sequence = begin + part, rest - part, sequence + 1
            room, offset = begin + part - at, at - begin
        take = min(room, length - start)
        out.append((start, take, sequence, offset))
        start, at = start + take, at + take
    return out


def tokenized(docs: DataFrame, encoder: tuple, end_id: int, window: int) -> DataFrame:
    """doc_id, doc_tokens, crcs of the whole windows, tail length, tail ids as bytes, number of the row in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = Encoder.of(*encoder).ids, 0
        for b in batches:
            tokens, crcs, tails, bodies = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = np.array(encode(text or "") + [end_id], "<u4")
                whole = len(ids) // window * window
                tokens.append(len(ids))
                crcs.append([crc32_u32(ids[i : i + window]) for i in range(0, whole, window)])
                tails.append(len(ids) - whole)
                bodies.append(ids[whole:].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.int32()), pa.array(bodies, pa.binary()), pa.array(np.arange(seen, seen + b.num_rows))], names=["doc_id", "doc_tokens", "crcs", "tail", "body", "nth"])
            seen += b.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens bigint, crcs array<bigint>, tail int, body binary, nth bigint")


def pack(spark: SparkSession, docs: DataFrame, encoder: tuple, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``encoder`` is (json path, ranks path or None, split pattern or None). A null
    or empty text is the end id alone; a text of any length is encoded whole and
    cut into as many windows as it fills. Each row is its own document, repeated
    and null ids included. An empty table gives no pieces; other columns are not
    read.
    """
    work = Workspace(spark, "packing")
    rows = work.save(tokenized(docs, encoder, end_id, window), "rows")
    n = rows.count()
    buckets = max(16, -(-n // BUCKET_ROWS))
    # equal rows differ in their number, so that many of them are dealt over the buckets
    bucket = F.pmod(F.xxhash64("doc_id", "doc_tokens", F.crc32("body"), "nth"), F.lit(buckets)).cast("int")
    keyed = rows.withColumn("bucket", bucket)
    # ranks within a length: counts of earlier buckets plus the place in the own bucket
    cells = keyed.groupBy("tail", "bucket").agg(F.count("*").alias("n"), F.sum(F.size("crcs")).alias("windows"))
    cells = work.save(cells, "cells")
    histogram = np.zeros(window, np.int64)
    for r in cells.groupBy("tail").agg(F.sum("n").alias("n")).collect():
        histogram[r["tail"]] = r["n"]
    plan = solve_slots(np.where(np.arange(window) > 0, histogram, 0), window)
    plan["bounds"] = np.searchsorted(plan["slots"][:, 0], np.arange(window + 1))
    tail_sequences = plan["sequences"] + plan["stream"] // window + bin(plan["stream"] % window).count("1")
    before = Window.partitionBy("tail").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # whole windows are numbered by (tail, bucket) cells: per tail first, then over the at most ``window`` tails
    per_tail = cells.groupBy("tail").agg(F.sum("windows").alias("w"))
    totals = np.zeros(window, np.int64)
    for r in per_tail.collect():
        totals[r["tail"]] = r["w"]
    first = tail_sequences + np.concatenate([[0], np.cumsum(totals)[:-1]])
    starts = cells.select(
        "tail",
        "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"),
        F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("window0"),
    )
    own = Window.partitionBy("tail", "bucket").orderBy("doc_id", "doc_tokens", F.crc32("body"), "nth")
    placed = (
        keyed.withColumn("_row", F.row_number().over(own) - 1)
        .withColumn("_windows", F.coalesce(F.sum(F.size("crcs")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(starts, ["tail", "bucket"])
        .select("doc_id", "doc_tokens", "crcs", "tail", "body", (F.col("rank0") + F.col("_row")).alias("rank"), (F.col("window0") + F.col("_windows")).alias("window0"))
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, tokens, crcs, tail, body, rank, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, crc in enumerate(crcs):
                    out.append((doc, i * window, window, crc, tokens, int(first[tail]) + w + i, 0))
                if tail:
                    ids, begin = np.frombuffer(body, "<u4"), tokens - tail
                    for start, length, sequence, offset in tail_pieces(plan, window, tail, rank):
                        out.append((doc, begin + start, length, crc32_u32(ids[start : start + length]), tokens, sequence, offset))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(pieces, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
