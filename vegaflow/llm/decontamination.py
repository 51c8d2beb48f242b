"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to k = rate * m
edits. Cut into k + 1 pieces, at least one piece of it is then untouched. One
pass of an Aho-Corasick automaton over a document finds every exact piece hit;
each hit fixes where the whole item would lie, and Myers' bit-parallel distance
verifies that window. Items come in blocks of bounded size, each its own pass,
so that the automaton of a task stays small however many items there are.

Items of under ``SHORT`` characters say too little to be matched with edits:
they have no budget, their one piece is the item itself, and a hit counts where
whole words of the text make it up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WORD = re.compile(r"\w+")
#: Characters of normalised items to a block, and so to an automaton.
BLOCK_CHARS = 4 << 20
#: Normalised items with fewer characters are matched exactly, at word borders.
SHORT = 20
#: First characters of scripts written without spaces (Thai to Khmer, Han, Kana): every place in them is a word border.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

_MATCHERS: dict[int, "Matcher"] = {}


def normalise(text: str | None) -> str:
    """Lower case, words parted by one space; marks and white space carry nothing."""
    return " ".join(WORD.findall(text.lower())) if text else ""


def cuts(m: int, k: int) -> list[int]:
    """k + 2 borders of k + 1 pieces of nearly equal length."""
    return [j * m // (k + 1) for j in range(k + 2)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def nearest(window: str, m: int, peq: dict[str, int]) -> tuple[int, int]:
    """(least edit distance of an m-character item to a substring of ``window``, its first end)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for i, ch in enumerate(window):
        eq = peq.get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1, mh << 1
        up = (mh | ~(xv | ph)) & full
        down = ph & xv & full
        if score < best:
            best, end = score, i + 1
    return best, end


def budget(item: str, rate: float) -> int:
    """Edits that an item may have."""
    return int(rate * len(item)) if len(item) >= SHORT else 0


def stands_alone(text: str, lo: int, hi: int) -> bool:
    """Are both ends of text[lo:hi] word borders?"""
    left = lo == 0 or text[lo - 1] == " " or UNSPACED.match(text[lo]) or UNSPACED.match(text[lo - 1])
    return bool(left and (hi == len(text) or text[hi] == " " or UNSPACED.match(text[hi - 1]) or UNSPACED.match(text[hi])))


class Matcher:
    """The automaton of one block of items: (id, normalised text) pairs."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(t, rate), masks(t)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for x, (_, t, k, _) in enumerate(self.items):
            c = cuts(len(t), k)
            for a, b in zip(c[:-1], c[1:], strict=True):
                places.setdefault(t[a:b], []).append((x, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int]]:
        """(item's place, least distance, end in the normalised text) of each item within its budget."""
        text = normalise(text)
        found: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[int]] = {}
        for at, (size, where) in self.automaton.iter(text) if text else ():
            for x, offset in where:
                start = at + 1 - size - offset
                _, item, k, peq = self.items[x]
                if x in found and found[x][0] == 0:
                    continue
                if len(item) < SHORT:
                    if stands_alone(text, start, at + 1):
                        found[x] = 0, at + 1
                        if first_only:
                            return [(x, 0, at + 1)]
                    continue
                seen = tried.setdefault(x, [])
                if seen and any(abs(start - s) <= k for s in reversed(seen[-8:])):
                    continue  # the window tried there reaches this far
                seen.append(start)
                lo = max(0, start - 2 * k)
                window = text[lo : start + len(item) + 2 * k]
                here = window.find(item)
                distance, end = (0, here + len(item)) if here >= 0 else nearest(window, len(item), peq)
                if distance <= k and (x not in found or distance < found[x][0]):
                    found[x] = distance, lo + end
                    if first_only:
                        return [(x, distance, lo + end)]
        return [(x, *found[x]) for x in sorted(found)]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``BLOCK_CHARS``, read one partition at a time."""
    held, size = [], 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        text = normalise(r[1])
        if not text:
            continue
        held.append((r[0], text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def matcher(key: int, items: list[tuple[int, str]], rate: float) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate)
    return _MATCHERS[key]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, end_char.

    ``distance`` is the least edit distance of the normalised item to a part of
    the normalised text, at most ``rate`` of the item's length; ``end_char`` is
    where that part first ends. Null and empty texts hold nothing, and null and
    empty items are nowhere; items of under ``SHORT`` normalised characters are
    found as whole words without an edit. Texts are read whole, however long.
    Repeated rows repeat, as do repeated items; null ids are kept. An empty
    table on either side gives no rows. Other columns are not read.
    """
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, distance int, end_char bigint"
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind, pa.string())
    out = None
    for items in blocks(benchmark, "item_id", "text"):
        key = hash((tuple(items), rate))

        def run(batches: Iterator[pa.RecordBatch], items=items, key=key) -> Iterator[pa.RecordBatch]:
            m = matcher(key, items, rate)
            for b in batches:
                rows = [(d, items[x][0], n, end) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x, n, end in m.matches(t)]
                ids, names, n, ends = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(names, item_type), pa.array(n, pa.int32()), pa.array(ends, pa.int64())], names=["doc_id", "item_id", "distance", "end_char"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], T.StructType.fromDDL(schema))


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no shuffle.

    Rows with a null or empty text hold nothing and stay; an empty benchmark
    leaves ``docs`` as it is.
    """
    at = docs.columns.index("text")
    for items in blocks(benchmark, "item_id", "text"):
        key = hash((tuple(items), rate))

        def run(batches: Iterator[pa.RecordBatch], items=items, key=key) -> Iterator[pa.RecordBatch]:
            m = matcher(key, items, rate)
            for b in batches:
                yield b.filter(pa.array([not m.matches(t, first_only=True) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
