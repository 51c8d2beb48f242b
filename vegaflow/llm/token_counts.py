"""Token counts by a join of distinct pre-tokens to per-document frequencies.

A sentencepiece BPE merge never crosses from a character into a following word
mark, as no piece of the vocabulary has a mark after another character. So the
count of a text is the sum over its pre-tokens: a run of marks with the word
behind it.

1. Every task sends its distinct pre-tokens with the number of texts that hold
   them; summed over the corpus, each is one row, whose pieces the library counts
   once.
2. The pre-tokens that most texts hold, at most ``HEAD`` of at most ``HEAD_CHARS``
   characters, are a table of bounded size and are broadcast; they are nearly all of
   a text, and the ones that a shuffle by word would send to few tasks.
3. A task turns a text into frequencies of its pre-tokens. Those in the broadcast
   table are joined and summed there; the others leave as (row, pre-token,
   frequency), are joined to the counts by a shuffle on the pre-token, summed by
   row, and added. Ids of pieces are never made.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vegaflow.llm.common import Workspace, text_slices

MARK = "▁"
UNITS = re.compile(r" *[^ ]+| +$")
#: Bound of the broadcast table: pre-tokens, and characters of one (at most 34 million in all).
HEAD, HEAD_CHARS = 1 << 17, 256
#: Distinct pre-tokens that a task holds before it sends them on, and bytes of text to a step.
HELD, CHUNK_BYTES = 1_000_000, 4 << 20


def pre_tokens(text: str | None) -> list[str]:
    """The pre-tokens of a text, each without its first mark; all of them joined by spaces are the text."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    words = text.split(" ")
    return [u[1:] for u in UNITS.findall(" " + text)] if "" in words else words


class Pieces:
    """Number of pieces of a pre-token as the library gives it."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)

    def of(self, words: list[str]) -> list[int]:
        return [len(x) if w else 1 for w, x in zip(words, self.model.encode(words), strict=True)]

    def parts_at_marks(self) -> bool:
        """Is a text the sum of its pre-tokens? No piece may hold a mark behind another character."""
        return not any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size()))


def met_words(docs: DataFrame, text_col: str) -> DataFrame:
    """word, texts: every distinct pre-token of the table and how many texts hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "texts"])
            held.clear()
            return out

        for b in (part for whole in batches for part in text_slices(whole, 0, CHUNK_BYTES)):
            for text in b.column(0).to_pylist():
                held.update(set(pre_tokens(text)))
            if len(held) > HELD:
                yield sent()
        yield sent()

    return docs.select(text_col).mapInArrow(run, "word string, texts bigint").groupBy("word").agg(F.sum("texts").alias("texts"))


def counted(words: DataFrame, model_path: str) -> DataFrame:
    """word, texts, pieces: each word once through the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces.of(b.column(0).to_pylist()), pa.int64())], names=["word", "texts", "pieces"])

    return words.select("word", "texts").mapInArrow(run, "word string, texts bigint, pieces bigint")


def joined(docs: DataFrame, head: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """id, _row, n_bytes, known (pieces of the words in ``head``), rare (word and frequency of the others)."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for b in (part for whole in batches for part in text_slices(whole, 1, CHUNK_BYTES)):
            known, words, times, ends, sizes = [], [], [], [0], []
            for text in b.column(1).to_pylist():
                sizes.append(len(text.encode()) if text else 0)
                found = list(map(pieces.get, own := pre_tokens(text)))
                if None in found:
                    rare = Counter(w for w, n in zip(own, found, strict=True) if n is None)
                    words += rare
                    times += rare.values()
                    found = filter(None, found)
                known.append(sum(found))
                ends.append(len(words))
            rare = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int32())], names=["word", "times"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)], names=[id_col, "n_bytes", "known", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, known bigint, rare array<struct<word:string,times:int>>")


def count_tokens(spark: SparkSession, docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    Texts are counted whole, however long; null and empty ones have 0 bytes and 0
    tokens. A null id is kept; repeated rows give repeated rows; an empty table
    gives none; other columns are not read. A vocabulary whose texts are not the
    sum of their pre-tokens is refused.
    """
    if not Pieces(model_path).parts_at_marks():
        raise ValueError("a piece of this vocabulary reaches over a word mark: pre-tokens cannot be counted on their own")
    work = Workspace(spark, "tokens")
    counts = work.save(counted(met_words(docs, text_col), model_path), "pieces")
    common = counts.where(F.length("word") <= HEAD_CHARS).orderBy(F.desc("texts"), "word").limit(HEAD)
    head = {r["word"]: r["pieces"] for r in common.select("word", "pieces").toLocalIterator()}
    rows = work.save(joined(docs, head, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "rows")
    rare = rows.where(F.size("rare") > 0).select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.times")
    sums = rare.join(counts.select("word", "pieces"), "word").groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n = F.col("known") + F.coalesce("more", F.lit(0))
    return rows.join(sums, "_row", "left").select(id_col, "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
