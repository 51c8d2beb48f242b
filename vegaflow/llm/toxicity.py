"""Toxicity scores by non-negative positive-unlabelled learning.

Positives are rows confirmed toxic; the unlabelled texts are drawn from all rows. The
risk of a classifier g with class prior p is
    p * R+(g) + max(0, R-_U(g) - p * R-_P(g)),
with the logistic loss; when the bracket is negative, the step ascends on it
instead (the non-negative correction), so the model cannot gain by pushing
positives hidden among the unlabelled texts below zero.

Features are words and word beginnings that are present in a text. The vocabulary
is chosen on the learning rows: the features whose document rate among positives exceeds the rate
among clean texts most. The model is a numpy linear model plus bias; a
task scores whole texts by one pass over their words.
"""

from __future__ import annotations

import dataclasses
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vegaflow.llm.common import held_out, text_slices

#: Words are runs of letters, digits or underscores, lower-cased.
WORD = re.compile(r"\w+")
#: Bounds on what the driver learns from: documents of each kind, about, by their distinct words.
MAX_POSITIVES, MAX_UNLABELLED = 2_000, 8_000
#: Class prior of toxic text if the labels give none.
DEFAULT_PRIOR = 0.05
CHUNK_BYTES = 4 << 20


#: Lengths of the word beginnings that count as features beside whole words; insults inflect.
STEMS = (3, 4, 5, 6)


def features(words: set[str]) -> set[str]:
    """Whole words, and their beginnings marked by a caret."""
    return words.union(*({f"^{w[:k]}" for w in words if len(w) > k} for k in STEMS))


@dataclasses.dataclass(frozen=True)
class ToxicModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias
        if text:
            index, w = self.vocabulary, self.weights
            for word in features(words_of(text)) & index.keys():
                z += w[index[word]]
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def choose_features(pos: dict[str, int], n: int, unl: dict[str, int], m: int, prior: float, size: int) -> list[str]:
    """Features by p * log((p + 1/n) / (c + 1/n)), p the document rate among positives, c that among clean texts.

    The clean rate is the unlabelled one less the positives' share of it. Only
    features at least 25 times as frequent in positives count. Ties by text.
    """
    gain = {}
    for w, k in pos.items():
        p = k / n
        c = max(0.0, unl.get(w, 0) / max(1, m) - prior * p) / (1 - prior)
        if p > 25 * c:
            gain[w] = p * math.log((p + 1 / n) / (c + 1 / n))
    return sorted(gain, key=lambda w: (-gain[w], w))[:size]


def fit_nnpu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, epochs: int = 800, rate: float = 0.08, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model by full-batch non-negative PU descent (Adam steps)."""
    d = x_pos.shape[1]
    theta, mean, square = (np.zeros(d + 1) for _ in range(3))
    theta[-1] = -1.0
    xp, xu = (np.hstack([x, np.ones((len(x), 1))]) for x in (x_pos, x_unl))

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for step in range(1, epochs + 1):
        zp, zu = xp @ theta, xu @ theta
        # logistic loss: log(1 + e^-z) for the positive class, log(1 + e^z) for the negative one
        bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_pos = -xp.T @ sigmoid(-zp) / len(xp)
        grad_neg = xu.T @ sigmoid(zu) / len(xu) - prior * (xp.T @ sigmoid(zp) / len(xp))
        grad = prior * grad_pos + grad_neg if bracket >= 0 else -grad_neg
        grad = grad + l2 * np.append(theta[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        theta = theta - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def without_copies(texts: Iterable[set[str]]) -> Iterator[set[str]]:
    """Feature sets of the texts, given by their words, one of each group of copies.

    A group is told by its two smallest word hashes (of words over seven
    letters, which are rarely shared by chance), so that a copied passage does
    not count as independent evidence.
    """
    seen = set()
    for words in texts:
        least = sorted(zlib.crc32(w.encode()) for w in words if len(w) > 7)[:2]
        key = tuple(least) if len(least) == 2 else tuple(sorted(words))
        if key not in seen:
            seen.add(key)
            yield features(words)


def matrix(docs: list[np.ndarray], columns: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(docs), len(columns)), "f4")
    for i, d in enumerate(docs):
        out[i, [columns[x] for x in d.tolist() if x in columns]] = 1
    return out


def fit(positive: Iterable[set[str]], unlabelled: Iterable[set[str]], prior: float, size: int = 512, least: int = 5) -> ToxicModel:
    """A model from the word sets of texts, each read once. Without positives every score is the prior.

    Only features of enough positives are held for the unlabelled texts.
    """
    prior = min(max(prior, 1e-3), 0.9)
    ids: dict[str, int] = {}
    pos = [np.array([ids.setdefault(f, len(ids)) for f in d], np.int32) for d in without_copies(positive)]
    counts = np.bincount(np.concatenate(pos), minlength=len(ids)) if pos else np.zeros(0, int)
    ids = {f: i for f, i in ids.items() if counts[i] >= max(least, len(pos) // 30)}
    unl = [np.array([ids[f] for f in d & ids.keys()], np.int32) for d in without_copies(unlabelled)] if ids else []
    there = np.bincount(np.concatenate(unl), minlength=len(counts)) if unl else np.zeros(len(counts), int)
    chosen = choose_features({f: int(counts[i]) for f, i in ids.items()}, max(1, len(pos)), {f: int(there[i]) for f, i in ids.items()}, len(unl), prior, size) if unl else []
    if not chosen:
        return ToxicModel({}, np.zeros(0), math.log(prior / (1 - prior)))
    columns = {ids[f]: k for k, f in enumerate(chosen)}
    w, b = fit_nnpu(matrix(pos, columns), matrix(unl, columns), prior)
    return ToxicModel({f: k for k, f in enumerate(chosen)}, w, b)


def training_words(docs: DataFrame, labels: DataFrame) -> tuple[Iterator[set[str]], Iterator[set[str]], float]:
    """(positives, unlabelled, prior) of the learning rows: word sets of whole texts, bounded samples by a hash of the id.

    The unlabelled texts are drawn from all learning rows, whatever their label,
    so that toxic text has its prior share among them. The labelled rows' toxic
    share is that prior. Words are taken in the tasks; the driver holds distinct
    ones of each text.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    known = learn.select("doc_id").join(marks, "doc_id").agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("t")).first()
    n, toxic, total = known["n"], known["t"] or 0, learn.agg(F.approx_count_distinct("doc_id")).first()[0]
    prior = toxic / n if toxic else DEFAULT_PRIOR
    readable = learn.where(F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 32))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(words_of(t)) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["words"])

    def texts(wanted: int, most: int, there: int) -> Iterator[set[str]]:
        share = F.lit(min(1 << 32, int((1 << 32) * most / max(1, there))))
        confirmed = marks.where("toxic = 1").select("doc_id")
        rows = readable.where(draw < share)
        rows = rows.join(confirmed, "doc_id", "left_semi") if wanted else rows
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))  # of an id that repeats, one row
        for r in rows.select("text").mapInArrow(distinct, "words array<string>").toLocalIterator():
            yield set(r["words"])

    return texts(1, MAX_POSITIVES, toxic), texts(0, MAX_UNLABELLED, total), prior


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row; a null or empty text has the score of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_slices(whole, 1, CHUNK_BYTES)):
            s = [model.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Fit on the learning rows of ``labels`` and score every row of ``docs``.

    Labels, language, source and id are not inputs of a score. Whole texts are
    scored, however long; null and empty ones as texts without words. Rows with a
    null id are scored and never learnt from; repeated rows are scored each. Of
    several labels of an id the toxic one counts; null ones do not. Without
    toxic learning rows every score is the prior; an empty table gives no rows.
    """
    return score_documents(docs, fit(*training_words(docs, labels)), threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns; no shuffle."""
    model, at = fit(*training_words(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_slices(whole, at, CHUNK_BYTES)):
            yield b.filter(pa.array([model.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
