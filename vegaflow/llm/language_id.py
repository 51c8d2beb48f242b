"""Language identification by a linear-chain conditional random field over words.

Every word of a text is a position of a chain whose states are languages. A
word scores for a language by hashed features: its affixes and inner n-grams of
2 to 4 bytes (word borders count as a byte, so the ones at a border are the
affixes) and its lexicon entry. Transitions between languages are learned from
code-switched chains spliced from the learning texts. Forward-backward gives
each word's language probabilities; a text's language has the largest sum.

Chains are cut every ``CHAIN`` words, so that very long texts cost no more per
word and any number of chains advances together in numpy.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vegaflow.llm.common import byte_slices, held_out, mix64
from vegaflow.llm.crf import forward_backward

LETTERS = re.compile(r"[^\W\d_]+")
CHAIN = 64
ORDERS = (2, 3, 4)
BUCKETS = 1 << 17
#: Bounds on what is learnt from: texts of each language, about, and chains of each text, spread over all of it.
MAX_TEXTS, MAX_CHAINS = 100, 4
#: Distinct words whose scores a task holds; beyond it, the table starts anew.
HELD_WORDS = 250_000
CHUNK_BYTES = 2 << 20
UNKNOWN = "und"

U = np.uint64


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; digits of any script (² or Ⅷ too) part words as marks do."""
    words = LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def chains_over(words: list[str]) -> list[str]:
    """At most ``MAX_CHAINS`` chains of words from the beginning to the end of a text, at equal distances."""
    if len(words) <= MAX_CHAINS * CHAIN:
        return words
    step = (len(words) - CHAIN) / (MAX_CHAINS - 1)
    return [w for i in range(MAX_CHAINS) for w in words[int(i * step) : int(i * step) + CHAIN]]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, feature bucket) for every feature of every word."""
    flat = np.frombuffer((" " + " ".join(words) + " ").encode(), "u1").astype(U)
    space = (flat == 32).astype(np.int64)
    upto = np.cumsum(space)
    owners, found = [], []
    for k in ORDERS:
        n = len(flat) - k + 1
        if n <= 0:
            continue
        gram = np.full(n, k, U)
        for j in range(k):
            gram = (gram << U(8)) | flat[j : j + n]
        inner = upto[k - 2 : k - 2 + n] - upto[:n] if k > 2 else np.zeros(n, np.int64)
        ok = np.flatnonzero((inner == 0) & (upto[:n] <= len(words)))
        if k == 2:
            ok = ok[~((space[ok] == 1) & (space[np.minimum(ok + 1, len(space) - 1)] == 1))]
        owners.append(upto[ok] - 1)
        found.append((mix64(gram[ok]) & U(BUCKETS - 1)).astype(np.int64))
    owners.append(np.arange(len(words)))
    found.append(np.array([xxhash.xxh3_64_intdigest(w) & (BUCKETS - 1) for w in words], np.int64))
    return np.concatenate(owners), np.concatenate(found)


@dataclasses.dataclass(frozen=True)
class ChainModel:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    transition: np.ndarray  # (labels, labels), scores

    def scores(self, words: list[str]) -> np.ndarray:
        owner, bucket = word_features(words)
        return np.stack([np.bincount(owner, self.weights[bucket, c], len(words)) for c in range(len(self.labels))], axis=1)


def chains(scores: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Scores cut into (chains, CHAIN, labels), padded, and the mask of real words."""
    parts = [min(CHAIN, n - i) for n in lengths for i in range(0, n, CHAIN)]
    rows = np.repeat(np.arange(len(parts)), parts)
    cols = np.arange(len(scores)) - np.repeat(np.cumsum([0, *parts[:-1]]), parts)
    out, mask = np.zeros((len(parts), CHAIN, scores.shape[1])), np.zeros((len(parts), CHAIN), bool)
    out[rows, cols], mask[rows, cols] = scores, True
    return out, mask


def spliced(texts: dict[str, list[list[str]]], labels: list[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Words and states of chains of ``CHAIN`` words, every second one switching language once."""
    words, states = [], []
    for c, label in enumerate(labels):
        pieces = [t[i : i + CHAIN] for t in texts[label] for i in range(0, len(t), CHAIN)]
        for p in pieces:
            cut = len(p)
            if len(labels) > 1 and len(p) > 8 and rng.random() < 0.5:
                cut = int(rng.integers(4, len(p) - 3))
                d = int(rng.integers(len(labels) - 1))
                d += d >= c
                other = texts[labels[d]][int(rng.integers(len(texts[labels[d]])))]
                start = int(rng.integers(max(1, len(other) - len(p))))
                rest = other[start : start + len(p) - cut]
                seq, tags = p[:cut] + rest, [c] * cut + [d] * len(rest)
            else:
                seq, tags = p, [c] * len(p)
            pad = CHAIN - len(seq)
            words += seq + [""] * pad
            states += tags + [-1] * pad
    return words, np.array(states, np.int64).reshape(-1, CHAIN)


def fit(texts: dict[str, list[list[str]]], rounds: int = 50, rate: float = 0.15, l2: float = 1e-6) -> ChainModel:
    """Maximum conditional likelihood of the spliced chains by Adam on all of them."""
    labels = sorted(x for x, docs in texts.items() if any(docs))
    k = len(labels)
    if k == 0:
        return ChainModel([], np.zeros((BUCKETS, 0), "f4"), np.zeros((0, 0)))
    texts = {x: [d for d in texts[x] if d] for x in labels}
    words, states = spliced(texts, labels, np.random.default_rng(7))
    mask = states >= 0
    distinct = {w: i for i, w in enumerate(dict.fromkeys(w for w in words if w))}
    owner, bucket = word_features(list(distinct))
    used, bucket = np.unique(bucket, return_inverse=True)
    place = np.array([distinct.get(w, 0) for w in words]).reshape(states.shape)
    hot = np.zeros((*states.shape, k))
    hot[mask, states[mask]] = 1
    seen = np.zeros((k, k))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(seen, (states[:, :-1][both], states[:, 1:][both]), 1)
    w, trans = np.zeros((len(used), k)), np.zeros((k, k))
    m, v, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    total = mask.sum()
    for step in range(1, rounds + 1):
        score = np.stack([np.bincount(owner, w[bucket, c], len(distinct)) for c in range(k)], axis=1)[place]
        marginal, moved = forward_backward(score, mask, trans, pairs=True)
        gap = np.where(mask[..., None], marginal - hot, 0).reshape(-1, k)
        by_word = np.stack([np.bincount(place.ravel(), gap[:, c], len(distinct)) for c in range(k)], axis=1)
        grad = np.stack([np.bincount(bucket, by_word[owner, c], len(used)) for c in range(k)], axis=1) / total + l2 * w
        grad_t = (moved - seen) / total
        for x, g, a, b in ((w, grad, m, v), (trans, grad_t, mt, vt)):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros((BUCKETS, k), "f4")
    weights[used] = w
    return ChainModel(labels, weights, trans)


def training_words(docs: DataFrame) -> dict[str, list[list[str]]]:
    """Words of a bounded sample, by hash of the id, of each language's learning rows; cut to chains in the tasks."""
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("count")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 32, int((1 << 32) * MAX_TEXTS / n)))))
    chosen = learn.where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 32)) < share[F.col("lang")])
    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.*")  # of an id that repeats, one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [chains_over(words_of(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), b.column(1)], names=["words", "lang"])

    out: dict[str, list[list[str]]] = {lang: [] for lang in counts}
    for r in chosen.select("text", "lang").mapInArrow(run, "words array<string>, lang string").collect():
        out[r["lang"]].append(r["words"])
    return out


class WordScores:
    """Scores of distinct words, computed for all new words of a chunk together."""

    def __init__(self, model: ChainModel):
        self.model, self.place = model, {}
        self.rows = np.zeros((1024, len(model.labels)))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > HELD_WORDS:
            self.place.clear()
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if new:
            have = len(self.place)
            while have + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[have : have + len(new)] = self.model.scores(new)
            self.place.update(zip(new, range(have, have + len(new)), strict=True))
        return self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def label_texts(texts: list[str | None], held: WordScores) -> list[tuple[str, float]]:
    model = held.model
    words = [words_of(t) for t in texts]
    lengths = [len(w) for w in words]
    out = [(UNKNOWN, 0.0)] * len(texts)
    flat = [w for ws in words for w in ws]
    if not flat or not model.labels:
        return out
    scores, mask = chains(held.of(flat), lengths)
    marginal, _ = forward_backward(scores, mask, model.transition)
    owner = np.repeat(np.arange(len(texts)), lengths)
    sums = np.stack([np.bincount(owner, marginal[mask][:, c], len(texts)) for c in range(len(model.labels))], axis=1)
    best = sums.argmax(axis=1)
    for i, n in enumerate(lengths):
        if n:
            out[i] = (model.labels[best[i]], min(1.0, float(sums[i, best[i]] / n)))
    return out


def identify(docs: DataFrame, model: ChainModel) -> DataFrame:
    """doc_id, lang_pred, score for every row; null texts and those without a letter are ``und`` with score 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WordScores(model)
        for whole in batches:
            texts = whole.column(1).to_pylist()
            sizes = np.array([len(t) if t else 0 for t in texts])
            for lo, hi in byte_slices(sizes, CHUNK_BYTES):
                found = label_texts(texts[lo:hi], held)
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(lo, hi - lo), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on the learning rows of ``docs`` and label every row; language and id are no inputs of a label.

    Whole texts are labelled, however long. Null and empty texts and those
    without a letter are ``und`` with score 0, and so is all if no row can be
    learnt from. Rows with a null id or language are labelled and never learnt
    from; repeated rows repeat; ties go to the first language by name. An empty
    table gives no rows; other columns are not read.
    """
    return identify(docs, fit(training_words(docs)))
