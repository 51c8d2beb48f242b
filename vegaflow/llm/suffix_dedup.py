"""Removal of repeated passages by sorting suffixes with bucket-pointer refinement.

Every byte covered by a ``depth``-byte string that also starts in a document
with a smaller id is removed. Suffixes of different texts need to meet only where
they can be equal, so they are dealt to tasks by anchors and sorted there:

1. Anchors: among the ``GRAM``-byte grams of each window of ``depth`` bytes the
   one with the least hash is its anchor. Equal strings have equal anchors at
   equal places, so a string whose anchor occurs in one document only cannot
   repeat. A batch of documents sends each anchor once.
2. Contexts: the bytes of all windows that share a surviving anchor. They are the
   suffixes to sort, and those with equal anchors meet in one task. An anchor with
   very many contexts is dealt anew by the bytes beside it: a window holds half a
   window's bytes on the left of its anchor or on the right, and equal windows
   hold the same.
3. A task sorts the suffixes of its contexts by bucket-pointer refinement. Buckets
   of equal ``Q``-grams are split by sorting their members by the bucket pointers
   of the suffixes that start where the bucket's known prefix ends. The pointers
   are updated at once, so all later splits, of the new buckets first, reuse them.
4. Of the suffixes that share ``depth`` bytes, the least document keeps its string;
   those of others are covered. Covered ranges are merged per text and cut out.

Before each shuffle equal input is aggregated: a copy of an earlier text is
covered whole, as are contexts that the batch has met in an earlier document.
Texts are told apart by id and hash, so rows that share an id keep their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.llm.common import Workspace, byte_slices, byte_views, mix64

DEPTH, GRAM = 50, 24
CHUNK_BYTES = 1 << 20
#: Bytes of contexts whose suffixes are sorted together in a task.
SORT_BYTES = 1 << 20
#: Contexts of a batch that later ones of it are compared with; beyond it, the table starts anew.
HELD_CONTEXTS = 200_000
#: Contexts of an anchor above which it is dealt anew by its neighbours.
HOT = 512
#: Bytes of a first bucket (nine bits each, so that the end of a text has a symbol of its own), and suffixes split in one step.
Q, STEP = 7, 1 << 16
ENDED = 1 << 40

U = np.uint64


def gram_hashes(flat: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every position (fewer positions than bytes by gram - 1).

    Built by doubling: the hash of 2k bytes joins two hashes of k bytes.
    """
    n = len(flat) - gram + 1
    if n <= 0:
        return np.zeros(0, U)
    power, done, out = flat.astype(U) + U(1), 0, None
    width, left = 1, gram
    while left:
        if left & 1:
            piece = power[done : done + n]
            out = piece.copy() if out is None else mix64(out * U(0x9E3779B97F4A7C15) + piece)
            done += width
        left >>= 1
        if left:
            power = power[: len(power) - width] * U(0xD6E8FEB86659FD93) + power[width:] * U(0xA0761D6478BD642F)
            power ^= power >> U(29)
            width *= 2
    return mix64(out)


def window_anchors(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of each run of windows of ``span`` grams with one anchor.

    The anchor is the leftmost least hash of the window.
    """
    n = len(hashes) - span + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    # leftmost minimum of span positions by doubling, on (hash, position)
    low, at = hashes, np.arange(len(hashes), dtype=np.int32)
    width = 1
    while width * 2 <= span:
        a, b = low[:-width], low[width:]
        take = b < a
        at = np.where(take, at[width:], at[:-width])
        low = np.where(take, b, a)
        width *= 2
    if width < span:
        shift = span - width
        a, b = low[:n], low[shift : shift + n]
        at = np.where(b < a, at[shift : shift + n], at[:n])
    at = at[:n]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first].astype(np.int64), first, np.r_[first[1:] - 1, n - 1]


def first_buckets(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, pointer, known): suffixes sorted by their first ``Q`` bytes; the pointer of each, which is
    where its bucket starts in the order; by that place, how many bytes all suffixes of the bucket share.

    A suffix that ends within ``Q`` bytes equals the others of its bucket to the end.
    """
    n = len(flat)
    at = np.arange(n)
    symbols = np.concatenate([flat.astype(U) + U(1), np.zeros(Q, U)])
    key = np.zeros(n, U)
    for k in range(Q):
        key = (key << U(9)) | np.where(at + k < ends, symbols[k : k + n], U(0))
    order = np.argsort(key)
    new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    pointer, known = np.empty(n, np.int64), np.full(n, Q, np.int64)
    pointer[order] = np.repeat(new, np.diff(np.r_[new, n]))
    known[new[ends[order[new]] - order[new] < Q]] = ENDED
    return order, pointer, known


def sorted_suffixes(flat: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, pointer) of all suffixes of ``flat`` sorted to ``depth`` bytes at least; ``ends[i]`` is where the text of position i ends."""
    n = len(flat)
    order, pointer, known = first_buckets(flat, ends)
    starts = np.flatnonzero(pointer[order] == np.arange(n))
    sizes = np.diff(np.r_[starts, n])
    wanted = (sizes > 1) & (known[starts] < depth)
    waiting = [(starts[wanted][::-1], sizes[wanted][::-1])]  # a stack: the buckets made last are at the end
    while waiting:
        starts, sizes = waiting.pop()
        if not len(starts):
            continue
        take = max(1, int(np.searchsorted(np.cumsum(sizes[::-1]), STEP, "right")))
        waiting.append((starts[:-take], sizes[:-take]))
        starts, sizes = starts[-take:], sizes[-take:]
        own = np.repeat(starts, sizes)
        slots = own + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        members, reach = order[slots], known[own]
        ahead = members + reach
        there = ahead < ends[members]
        later = np.where(there, pointer[np.where(there, ahead, 0)], -1)
        shared = np.where(there, reach + known[later], ENDED)
        key = own * (n + 1) + later + 1
        by = np.argsort(key)
        # the slots of each bucket, in its own order
        slots = np.sort(slots)
        key, members, shared = key[by], members[by], shared[by]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[new, len(key)])
        order[slots] = members
        pointer[members] = np.repeat(slots[new], size)
        known[slots[new]] = np.minimum(shared[new], ENDED)
        more = (size > 1) & (shared[new] < depth)
        waiting.append((slots[new][more][::-1], size[more][::-1]))
    return order, pointer


def refine(flat: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """A number for every suffix of ``depth`` (8 or more) bytes, equal for those that share them; -1 for shorter ones.

    The sort may go deeper than ``depth``; neighbours of different buckets are
    therefore compared by their bytes.
    """
    n = len(flat)
    order, pointer = sorted_suffixes(flat, ends, depth)
    order = order[ends[order] - order >= depth]
    padded = np.concatenate([flat, np.zeros(8, "u1")])
    words = np.zeros(n, U)
    for k in range(8):
        words = (words << U(8)) | padded[k : k + n]
    a, b = order[:-1], order[1:]
    differ = pointer[a] != pointer[b]
    a, b = a[differ], b[differ]
    unlike = np.zeros(len(a), bool)
    for k in (*range(0, depth - 8, 8), depth - 8):
        unlike |= words[a + k] != words[b + k]
    differ[np.flatnonzero(differ)[~unlike]] = False
    out = np.full(n, -1, np.int64)
    if len(order):
        out[order] = np.r_[0, np.cumsum(differ)]
    return out


def repeated_windows(contexts: list[bytes], docs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of every ``depth``-byte string that a context of a smaller document holds too."""
    flat = np.frombuffer(b"".join(contexts), "u1")
    sizes = np.array([len(c) for c in contexts])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), sizes)
    ids = refine(flat, (starts + sizes)[owner], depth)
    full = np.flatnonzero((starts + sizes)[owner] - np.arange(len(flat)) >= depth)
    order = full[np.argsort(ids[full])]
    if not len(order):
        z = np.zeros(0, np.int64)
        return z, z
    first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    least = np.minimum.reduceat(docs[owner[order]], first)
    hit = order[docs[owner[order]] > np.repeat(least, np.diff(np.r_[first, len(order)]))]
    return owner[hit], hit - starts[owner[hit]]


def doc_anchors(flat: np.ndarray, starts: np.ndarray, depth: int, gram: int, places: bool = False):
    """(document, anchor hash, context start, context end) of a chunk, within the chunk's bytes; with ``places``, the anchor's place is third."""
    hashes = gram_hashes(flat, gram)
    out = []
    for d in range(len(starts) - 1):
        lo, hi = int(starts[d]), int(starts[d + 1])
        at, first, last = window_anchors(hashes[lo : hi - gram + 1], depth - gram + 1) if hi - lo >= depth else (np.zeros(0, np.int64),) * 3
        if len(at):
            out.append((np.full(len(at), d), hashes[lo + at], lo + at, lo + first, lo + last + depth))
    z = np.zeros(0, np.int64)
    own, found, at, first, end = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (z, np.zeros(0, U), z, z, z)
    return (own, found, at, first, end) if places else (own, found, first, end)


def sent_anchors(docs: DataFrame, depth: int, gram: int) -> DataFrame:
    """From (doc_id, text): hash, doc_id, salt, more. Each anchor once a batch with salt 0; its repeats in the batch under salts of their own.

    ``more`` says that another text of the batch has the anchor as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            flat, starts = byte_views(whole.column(1))
            rows, found = np.arange(whole.num_rows), []
            for lo, hi in byte_slices(np.diff(starts), CHUNK_BYTES):
                own, h, _, _ = doc_anchors(flat[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], depth, gram)
                found.append((h, rows[lo:hi][own]))
            h, row = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U), rows)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
            h, row = h[new], row[new]
            head = np.r_[True, h[1:] != h[:-1]][: len(h)]
            more = head & np.r_[~head[1:], False][: len(h)]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(h.view("i8")), whole.column(0).take(at), pa.array(np.where(head, 0, row + 1)), pa.array(more)], names=["hash", "doc_id", "salt", "more"])

    return docs.select("doc_id", "text").mapInArrow(run, "hash bigint, doc_id bigint, salt bigint, more boolean")


CONTEXT = "hash bigint, doc_id bigint, mark bigint, start int, left int, body binary, size int"


def context_batch(hashes, docs, marks, starts, lefts, bodies: list[bytes], met: dict[bytes, int]) -> pa.RecordBatch:
    """A batch of contexts; those that an earlier document of ``met`` has are sent without their body: covered whole already."""
    if len(met) > HELD_CONTEXTS:
        met.clear()
    firsts = [met.setdefault(x, d) for x, d in zip(bodies, docs, strict=True)]
    kept = [x if d == f else None for x, d, f in zip(bodies, docs, firsts, strict=True)]
    columns = [pa.array(hashes, pa.int64()), pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(starts, pa.int32()), pa.array(lefts, pa.int32()), pa.array(kept, pa.binary()), pa.array(list(map(len, bodies)), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["hash", "doc_id", "mark", "start", "left", "body", "size"])


def by_document(batch: pa.RecordBatch, column: int) -> pa.RecordBatch:
    return batch.take(pa.array(np.argsort(batch.column(column).to_numpy(zero_copy_only=False), kind="stable")))


def sent_contexts(rows: DataFrame, depth: int, gram: int) -> DataFrame:
    """From (doc_id, text, mark, hashes): the contexts of the anchors among ``hashes``; ``left`` is the anchor's place in the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = by_document(whole, 0)
            flat, starts = byte_views(whole.column(1))
            ids, marks, lists = whole.column(0).to_numpy(zero_copy_only=False), whole.column(2).to_numpy(zero_copy_only=False), whole.column(3)
            met: dict[bytes, int] = {}
            for lo, hi in byte_slices(np.diff(starts), CHUNK_BYTES):
                base = int(starts[lo])
                part = flat[base : starts[hi]]
                begins = starts[lo : hi + 1] - base
                own, h, at, first, end = doc_anchors(part, begins, depth, gram, places=True)
                signed = h.view("i8")
                edges = np.searchsorted(own, np.arange(hi - lo + 1))
                chosen = [a + np.flatnonzero(np.isin(signed[a:b], lists[lo + d].values.to_numpy(zero_copy_only=False))) for d, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
                k = np.concatenate(chosen or [np.zeros(0, np.int64)])
                raw = part.tobytes()
                bodies = [raw[x:y] for x, y in zip(first[k].tolist(), end[k].tolist(), strict=True)]
                yield context_batch(signed[k], ids[lo:hi][own[k]].tolist(), marks[lo:hi][own[k]], first[k] - begins[own[k]], at[k] - first[k], bodies, met)

    return rows.select("doc_id", "text", "mark", "hashes").mapInArrow(run, CONTEXT)


def dealt_anew(contexts: DataFrame, depth: int, gram: int) -> DataFrame:
    """Contexts of hot anchors in at most two parts each, under keys of the anchor and its neighbours.

    With ``half`` bytes of a window beside its anchor, a window has at least so
    many on the left, or more than the others' rest on the right.
    """
    half = (depth - gram) // 2
    rest = depth - gram - half + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met: dict[bytes, int] = {}  # of this batch only: the documents of the next one may be smaller
            out: tuple[list, ...] = ([], [], [], [], [], [])

            def part(h: int, near: bytes, doc: int, mark: int, start: int, left: int, body: bytes, out=out) -> None:
                for column, x in zip(out, (xxhash.xxh3_64_intdigest(near, h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), doc, mark, start, left, body), strict=True):
                    column.append(x)

            for h, doc, mark, start, left, body in zip(*(c.to_pylist() for c in by_document(b, 1).columns), strict=True):
                last = len(body) - depth  # windows start from 0 to here
                if left >= half:
                    part(h, b"l" + body[left - half : left], doc, mark, start, left, body[: min(left - half, last) + depth])
                if last >= (cut := max(0, left - half + 1)):
                    part(h, b"r" + body[left + gram : left + gram + rest], doc, mark, start + cut, left - cut, body[cut:])
            yield context_batch(*out, met)

    return contexts.select("hash", "doc_id", "mark", "start", "left", "body").mapInArrow(run, CONTEXT)


def sorted_ranges(contexts: DataFrame, depth: int) -> DataFrame:
    """doc_id, mark, start, end covered, from contexts dealt by hash and sorted by it and by document in each partition.

    Of equal contexts only the first document's is sorted, the others are
    covered whole; an anchor left with one context has nothing to sort.
    """
    names = ["doc_id", "mark", "start", "end"]

    def ranges(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        docs, marks, starts = (np.array([x[k] for x in held], np.int64) for k in range(3))
        own, at = repeated_windows([x[3] for x in held], docs, depth)
        begin = starts[own] + at
        order = np.lexsort((begin, marks[own], docs[own]))
        own, begin = own[order], begin[order]
        doc, mark = docs[own], marks[own]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (begin[1:] > begin[:-1] + 1)][: len(doc)])
        last = np.r_[new[1:] - 1, len(doc) - 1] if len(doc) else new
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[new], mark[new], begin[new], begin[last] + depth)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        now, group = None, {}  # the contexts of one anchor: body -> (document, its texts and starts)

        def closed() -> int:
            if len(group) > 1:
                held.extend((doc, mark, start, body) for body, (doc, begins) in group.items() for mark, start in begins)
                return sum(len(body) * len(begins) for body, (_, begins) in group.items())
            return 0

        for b in batches:
            whole: tuple[list, ...] = ([], [], [], [])
            for h, doc, mark, start, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != now:
                    size += closed()
                    now, group = h, {}
                    if size >= SORT_BYTES:
                        yield ranges(held)
                        held, size = [], 0
                first = group.setdefault(body, (doc, set()))
                if first[0] == doc:
                    first[1].add((mark, start))
                else:
                    for column, x in zip(whole, (doc, mark, start, start + len(body)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in whole], names=names)
        closed()
        if held:
            yield ranges(held)

    return contexts.select("hash", "doc_id", "mark", "start", "body").mapInArrow(run, "doc_id bigint, mark bigint, start bigint, end bigint")


def covered(docs: DataFrame, work: Workspace, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, ranges): covered ranges of the texts that have any; not yet merged.

    ``mark`` is 0, but a hash of the text where several texts share the id.
    """
    able = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= depth))
    texts = work.save(able.select("doc_id", F.xxhash64("text").alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_hash"), F.octet_length("text").cast("long").alias("size")), "texts")
    several = texts.groupBy("doc_id").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi")
    several = work.save(several.select("doc_id", F.lit(True).alias("several")), "several")
    marked = lambda rows, own: rows.join(several, "doc_id", "left").withColumn("mark", F.when(F.col("several"), own).otherwise(F.lit(0).cast("long"))).drop("several")
    able = marked(able, F.xxhash64("text"))
    # written before it is joined, so that a text on a large share of the rows is split over tasks
    firsts = work.save(texts.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    copies = marked(texts.join(firsts, "text_hash").where("doc_id > first"), F.col("own"))
    copies = work.save(copies.select("doc_id", "mark", "size").distinct(), "copies")
    alone = able.join(copies, ["doc_id", "mark"], "left_anti")
    hashed = sent_anchors(alone, depth, gram)
    same = Window.partitionBy("hash", "salt")
    shared = hashed.withColumns({"lo": F.min("doc_id").over(same), "hi": F.max("doc_id").over(same)}).where("salt > 0 or more or lo < hi")
    shared = work.save(shared.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes")), "anchors")
    contexts = work.save(sent_contexts(able.join(shared, "doc_id"), depth, gram), "contexts")
    sent = contexts.where("body is not null")
    hot = work.save(sent.groupBy("hash").count().where(F.col("count") > HOT).select("hash"), "hot")
    anew = work.save(dealt_anew(sent.join(hot, "hash", "left_semi"), depth, gram), "anew")
    ready = sent.join(hot, "hash", "left_anti").unionByName(anew.where("body is not null"))
    dealt = ready.select("hash", "doc_id", "mark", "start", "body").repartition("hash").sortWithinPartitions("hash", "doc_id")
    part = work.save(sorted_ranges(dealt, depth), "ranges")
    whole = contexts.unionByName(anew).where("body is null").select("doc_id", "mark", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("end"))
    every = part.unionAll(whole).unionAll(copies.select("doc_id", "mark", F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    return every.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in ranges or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def with_spans(docs: DataFrame, ranges: DataFrame, depth: int) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and one of ranges (null where nothing is covered), and its name, which is none of theirs.

    Texts under ``depth`` bytes have no ranges, but may share the id of a text that has.
    """
    taken = {c.lower() for c in docs.columns}
    free = next(p for p in ("_" * n for n in range(1, len(taken) + 2)) if not {p + "doc", p + "mark", p + "ranges"} & taken)
    found = ranges.toDF(free + "doc", free + "mark", free + "ranges")
    own = (F.col(free + "mark") == 0) | (F.col(free + "mark") == F.xxhash64("text"))
    own &= F.octet_length("text") >= depth
    return docs.join(found, (F.col("doc_id") == F.col(free + "doc")) & own, "left").drop(free + "doc", free + "mark"), free + "ranges"


def remove_repeats(spark: SparkSession, docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A null text is empty; a text of any length is read whole. Texts under
    ``depth`` bytes and rows with a null id lose nothing. Rows that share an id
    are told apart by their texts: none is a document with a smaller id than the
    other, so they take nothing from each other, and equal rows get the same
    answer. An empty table gives no rows; other columns are not read.
    """
    work = Workspace(spark, "repeats")
    rows, spans_col = with_spans(docs.select("doc_id", "text"), covered(docs, work, depth), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, ranges in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw, spans = (text or "").encode(), merged(ranges)
                out.append((doc, len(raw), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest(), [[x, y] for x, y in spans]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", spans_col).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>")


def without_repeats(spark: SparkSession, docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs`` with repeated passages cut out of text; a character cut in two goes with them.

    ``n_chars``, if there, is counted anew. Rows whose text is left empty stay.
    """
    work = Workspace(spark, "repeats")
    rows, spans_col = with_spans(docs, covered(docs, work, depth), depth)
    names, kept = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not r else kept_bytes(t.encode(), merged(r)).decode(errors="ignore") for t, r in zip(b.column("text").to_pylist(), b.column(spans_col).to_pylist(), strict=True)]
            columns = {n: b.column(n) for n in names}
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = rows.mapInArrow(run, kept)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
