"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch has t coordinates. In round i every shingle is hashed to a coordinate
and a value; a coordinate keeps the least value of the earliest round that
reached it. Up to round t the coordinate is random, afterwards round t + j
places every shingle at coordinate j, so every coordinate is filled after at most 2t
rounds, while a large set needs about one. Two sets agree in a coordinate with
probability equal to their Jaccard similarity, concentrated as by minwise
hashing with t independent functions.

1. Documents with the same shingle set form a class; only its least id goes on.
2. Bands of coordinates are hashed; each bucket links its members to its hub, the
   member that meets most others. Those pairs are verified on the full sets, as are
   members of a class whose words differ from those of its least id (equal words,
   told by their SHA-256, have equal sets).
3. Buckets whose members are not all connected by then are finished: in blocks of
   bounded size, every pair from different components is compared, in its first
   common bucket only, by sketch and then by the sets folded to 65,536 bits, with
   a bound that no pair at the threshold can fail. A block gives only pairs that
   pass both, and those are verified on the full sets.
4. Components are the transitive closure of the verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vegaflow.llm.common import Workspace, mix64, text_slices
from vegaflow.llm.components import components

#: 48 bands of 6: a pair at 0.8 is missed with probability (1 - 0.8**6)**48 < 1e-6.
BANDS, ROWS = 48, 6
#: Share of agreeing coordinates that the finishing blocks ask for: 0.8 lies six deviations above.
AGREE = 0.66
#: Members to a finishing block; rows and bytes of folded sets to a group of smaller buckets, about.
BLOCK, GROUP_ROWS, GROUP_BYTES = 1024, 2048, 16 << 20
CHUNK_BYTES = 2 << 20
#: Bits to an id in the filter of texts, bits of it at most (16 MB), and of one bitmap of Spark.
FILTER_BITS, MOST_BITS, BITMAP = 32, 1 << 27, 1 << 15
HELD_WORDS = 200_000

U = np.uint64
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words parted by ASCII white space, A-Z lowered."""
    return text.encode().lower().split() if text else []


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), U)
    for k in range(min(width, len(h))):
        out = mix64(out * U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """(len(sets), t) fast similarity sketches; an empty set stays at the largest value."""
    out = np.full(len(sets) * t, _EMPTY)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, U)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix64(items ^ mix64(np.array([i + 1], U))[0])
        low = (U(i) << U(40)) | (h & U((1 << 40) - 1))
        bins = ((h >> U(40)) * U(t) >> U(24)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, owner * t + bins, low)
        open_rows = (out.reshape(-1, t) == _EMPTY).any(axis=1)
        keep = open_rows[owner]
        if not keep.all():
            items, owner = items[keep], owner[keep]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(sketch), bands)).copy()
    parts = sketch.reshape(len(sketch), bands, rows)
    for r in range(rows):
        keys = mix64(keys * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint of the set), words (digest of all words), bands, sketch (a byte a coordinate), folded (the set modulo 65,536)."""
    t = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for b in text_slices(whole, 1, CHUNK_BYTES):
                sets, digests = [], []
                for text in b.column(1).to_pylist():
                    if len(hashes) > HELD_WORDS:
                        hashes.clear()
                    words = words_of(text)
                    sets.append(shingle_set(words, width, hashes))
                    digests.append(hashlib.sha256(b" ".join(words)).digest())
                sk = sketches(sets, t)
                marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
                keys = band_keys(sk, BANDS, ROWS).view("i8")
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                small = (mix64(sk.copy()) & U(255)).astype("u1")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(digests, pa.binary()), bands, pa.array([x.tobytes() for x in small], pa.binary()), pa.array([np.unique((s & U(0xFFFF)).astype("<u2")).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n", "f1", "f2", "words", "bands", "sketch", "folded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, f1 bigint, f2 bigint, words binary, bands array<bigint>, sketch binary, folded binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set, f1: the shingle hashes as bytes, and the first half of their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in (part for whole in batches for part in text_slices(whole, 1, CHUNK_BYTES)):
            sets = []
            for text in b.column(1).to_pylist():
                if len(hashes) > HELD_WORDS:
                    hashes.clear()
                sets.append(shingle_set(words_of(text), width, hashes).tobytes())
            marks = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, sets)), "<i8")[::2]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), pa.array(marks)], names=["doc_id", "set", "f1"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set binary, f1 bigint")


def that_count(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of the rows of a repeated id, those with the set that stands for it."""
    return rows.join(repeated.withColumnRenamed("f1", "_least"), "doc_id", "left").where("_least is null or f1 = _least").drop("_least")


def maybe_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, and a few others: a filter before a join, so that it shuffles few texts in vain.

    Hashes of the ids are marked in bitmaps, ``FILTER_BITS`` to an id but at most
    ``MOST_BITS`` in all, which is what is broadcast.
    """
    bits = min(MOST_BITS, max(BITMAP, 1 << (FILTER_BITS * max(1, ids.count()) - 1).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    marked = ids.groupBy(F.floor(place / BITMAP).alias("_block")).agg(F.bitmap_construct_agg(place % BITMAP).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (place % 8).cast("int")) == 1
    return docs.join(F.broadcast(marked), (F.floor(place / BITMAP) == F.col("_block")) & hit, "left_semi")


def verified(work: Workspace, name: str, pairs: DataFrame, docs: DataFrame, repeated: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent`` of Jaccard similarity.

    The sets are written first, so that the joins are of plain shuffles: the
    pairs of a hub with very many members are split over tasks.
    """
    # written, so that Spark plans the join to the texts by the true size of the ids and shuffles no text for a few
    ids = work.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    texts = maybe_among(docs.select("doc_id", "text"), ids).join(ids, "doc_id", "left_semi")
    sets = that_count(full_sets(texts, width), repeated)
    sets = work.save(sets.where("octet_length(set) > 0").drop("f1").dropDuplicates(["doc_id"]), f"{name}-sets")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                if x.equals(y):
                    keep.append(True)
                    continue
                u, v = np.frombuffer(x, U), np.frombuffer(y, U)
                common = len(u) + len(v) - len(np.union1d(u, v))
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    links = work.save(both.mapInArrow(run, f"a {kind}, b {kind}"), name)
    work.drop(f"{name}-sets")
    work.drop(f"{name}-ids")
    return links


def fitting_sizes(x, y, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def bitset(folded: bytes) -> int:
    bits = np.zeros(1 << 16, "u1")
    bits[np.frombuffer(folded, "<u2")] = 1
    return int.from_bytes(np.packbits(bits).tobytes())


def block_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs from different components with fitting sizes that pass the sketch and the folded sets.

    The shingles that two sets share fold to at most so many fewer values as
    either set lost by folding, its size less its distinct values. With the lesser
    of both losses added, the common part is never taken for less than it is.
    """
    found: list[tuple[int, int]] = []
    crossing = rows["i"].iloc[0] != rows["j"].iloc[0]
    for key, g in rows.groupby("key", sort=False):
        g = g.drop_duplicates("doc_id")
        ids, n, comp, mine = (g[c].to_numpy() for c in ("doc_id", "n", "component", "mine"))
        sk = np.frombuffer(b"".join(g["sketch"]), "u1").reshape(len(g), -1)
        bands = np.stack(g["bands"].to_list())
        bits: dict[int, int] = {}
        folded = g["folded"].to_numpy()
        lost = n - np.fromiter(map(len, folded), np.int64, len(g)) // 2
        for i in range(len(g) - 1):
            j = np.arange(i + 1, len(g))
            ok = (comp[j] != comp[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent)
            if crossing:
                ok &= mine[j] != mine[i]
            j = j[ok]
            if not len(j):
                continue
            j = j[(sk[j] == sk[i]).mean(axis=1) >= AGREE * percent / 80]
            if not len(j):
                continue
            same = bands[j] == bands[i]
            j = j[bands[i][same.argmax(axis=1)] == key]
            for k in j.tolist():
                for x in (i, k):
                    if x not in bits:
                        bits[x] = bitset(folded[x])
                common = (bits[i] & bits[k]).bit_count()
                common += int(min(lost[i], lost[k]))
                if 100 * common >= percent * (int(n[i]) + int(n[k]) - common):
                    found.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Sets hold the distinct ``width``-word shingles; with fewer words the whole
    sequence is one. Null, empty and blank texts have no shingle and no link. A
    row with a null id is linked with nothing, has a null component and is kept.
    Repeated rows get the same answer each. An id stands for one text: where rows
    that share it have different sets, the one of the least fingerprint counts,
    and all rows of the id with a shingle get its component. Texts are read whole,
    however long. An empty table gives no rows; other columns are not read.
    """
    work = Workspace(spark, "near")
    marks = work.save(described(docs, width), "marks")
    full = marks.where("n > 0 and doc_id is not null")
    repeated = full.groupBy("doc_id").agg(F.min("f1").alias("f1"), F.count("*").alias("rows")).where("rows > 1")
    repeated = work.save(repeated.drop("rows"), "repeated")
    # what is joined by a key that many rows may share is written first: the join is then one of plain shuffles and is split over tasks
    one = that_count(full, repeated)
    classes = one.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "words")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    classes = work.save(classes.select("f1", "f2", F.col("first.doc_id").alias("rep"), F.col("first.words").alias("rep_words")), "classes")
    copies = one.select("doc_id", "f1", "f2", "words").join(classes, ["f1", "f2"]).where("doc_id <> rep")
    copies = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), (F.col("words") == F.col("rep_words")).alias("same")).distinct()
    copies = work.save(copies, "copies")
    firsts = one.join(copies.select(F.col("b").alias("doc_id")), "doc_id", "left_anti").dropDuplicates(["doc_id"])
    banded = firsts.select("doc_id", "n", F.explode("bands").alias("key"))
    buckets = work.save(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    linked = work.save(banded.join(buckets.hint("merge"), "key"), "linked")  # one plan at every size: buckets grow with the table
    # the hub of a bucket is the member that meets most others in all its buckets: the text that others were copied from
    met = linked.groupBy("doc_id").agg(F.sum("size").alias("met"))
    scored = linked.join(met, "doc_id")
    hubs = scored.groupBy("key").agg(F.min(F.struct(-F.col("met"), "doc_id", "n")).alias("hub"))
    hubs = work.save(hubs.select("key", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("n_hub")), "hubs")
    tried = linked.join(hubs.hint("merge"), "key").where((F.col("doc_id") != F.col("hub")) & fitting_sizes(F.col("n"), F.col("n_hub"), percent))
    tried = tried.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    tried = work.save(tried, "tried")
    links = verified(work, "links", tried.unionAll(copies.where("not same").drop("same")), docs, repeated, width, percent).unionAll(copies.where("same").drop("same"))
    groups = work.save(components(work, links, "stars"), "groups")

    # buckets that the stars did not connect
    named = linked.where("size > 2").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", "size", F.coalesce("component", "doc_id").alias("component"))
    named = work.save(named, "named")
    split = work.save(named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "split")
    open_rows = work.save(named.join(split, "key", "left_semi"), "open")
    known = open_rows.agg(F.count("*").alias("n"), F.sum(F.least(2 * F.col("n"), F.lit(1 << 17))).alias("bytes")).first()
    groups_of_small = max(64, known["n"] // GROUP_ROWS, (known["bytes"] or 0) // GROUP_BYTES)
    # their ids are those of ``firsts``; of all other rows, next to none are shuffled
    open_ids = open_rows.select("doc_id").distinct()
    sketched = maybe_among(full.select("doc_id", "f1", "sketch", "bands", "folded"), open_ids).join(open_ids.hint("merge"), "doc_id", "left_semi")
    sketched = that_count(sketched, repeated).dropDuplicates(["doc_id"]).drop("f1")
    rest = open_rows.join(sketched, "doc_id").withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    carried = ["mine", "key", "doc_id", "n", "component", "sketch", "bands", "folded"]
    small = rest.where("blocks = 1").select(F.pmod(F.xxhash64("key"), F.lit(groups_of_small)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), *carried)
    large = rest.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("key").alias("g"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), *carried)
    more = small.unionAll(large).groupBy("g", "i", "j").applyInPandas(lambda df: block_pairs(df, percent), "a bigint, b bigint").distinct()
    more = work.save(more.join(tried, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        extra = verified(work, "extra", more, docs, repeated, width, percent)
        # the stars are settled: only their least ids are linked further
        near = groups.toDF("a", "ca")
        far = groups.toDF("b", "cb")
        over = extra.join(near, "a", "left").join(far, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        lower = components(work, over, "over").toDF("component", "lower")
        joined = groups.unionAll(extra.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(groups, "id", "left_anti").select("id", F.col("id").alias("component")))
        groups = joined.join(lower, "component", "left").select("id", F.coalesce("lower", "component").alias("component"))
    for name in ("classes", "copies", "buckets", "linked", "hubs", "tried", "links", "named", "split", "open", "more"):  # the result reads groups and marks only
        work.drop(name)
    linked_ids = groups.toDF("doc_id", "component")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    found = marks.select("doc_id", "n").join(linked_ids, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
