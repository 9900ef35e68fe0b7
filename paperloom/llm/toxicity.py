"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence is toxic with probability p = sigmoid(b + sum of its words' scores), and the
document with 1 - prod(1 - p), the noisy-or: one bad sentence suffices.  Only documents are labelled; the likelihood of
their labels under the noisy-or trains the word scores, and the sentences then show where the offence is.  A word's score
is the sum of the weights of hashed features (the word and its character 4-grams), so unseen inflections have one too.

Harmless sentences aren't quite certain ones, and a noisy-or over enough of them would call any long text toxic.  So training
also learns the background: how high the sentences of clean training documents score.  Of a text with n sentences only those count that go
beyond the level which a clean sentence exceeds with probability ``SHARE`` / n, and only as far as they do; beyond the highest
levels seen, an exponential tail goes on.  A short text loses next to nothing by it, and a clean text may be of any length.

Training takes a bounded sample of labelled rows: at most ``PER_CLASS`` documents of each label, those with the smallest
hashes of their ids.  Scoring takes every text whole.

Defined results: null and empty texts have no sentence and score 0; without both labels in the sample every score is 0;
repeated rows are scored alike and stay repeated; extra columns are kept by :func:`keep_clean` and not returned by
:func:`score`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, remainder, table

#: Documents of each label in the training sample, hashed features, remembered words of a worker.
PER_CLASS, FEATURES, REMEMBERED = 2500, 1 << 18, 400_000

#: Sentences of a clean text, of any length, that may count by chance.
SHARE = 0.03

#: Score from which a document counts as toxic; probability from which a sentence is reported.
THRESHOLD, OFFENDING = 0.7, 0.5

_SENTENCES = re.compile(r"[^.!?\n]+")
_WORDS = re.compile(r"\w+").findall


def word_features(word: str) -> list[int]:
    """Places of a word's features: itself and its character 4-grams, edges marked."""
    edged = f"^{word}$"
    grams = {edged[i : i + 4] for i in range(len(edged) - 3)}
    return [zlib.crc32(x.encode()) % FEATURES for x in (f"={word}", *sorted(grams))]


@dataclass
class Background:
    """The highest logits of sentences of clean documents, falling, of ``count`` in all."""

    highest: np.ndarray
    count: int

    @classmethod
    def of(cls, logits: np.ndarray) -> Background:
        return cls(np.sort(logits)[::-1][: int(len(logits) * SHARE) + 1].astype(np.float32), len(logits))

    def level(self, n: int) -> float:
        """What a clean sentence exceeds with probability SHARE / n: an order statistic, or the tail beyond the 500th part."""
        place, tail = SHARE / n * self.count, max(10, self.count // 500)
        if tail >= len(self.highest):
            return -math.inf
        if place >= tail:
            return float(self.highest[int(place)])
        start = float(self.highest[tail])
        return start + max(0.5, float(self.highest[:tail].mean()) - start) * math.log(tail / place)


@dataclass
class Model:
    """Weights, bias and, if it was learned, the background; ``known`` remembers word scores where the model is used."""

    weights: np.ndarray
    bias: float
    background: Background | None = None
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.weights, self.bias, self.background

    def __setstate__(self, state):
        self.weights, self.bias, self.background, self.known = *state, {}

    def word(self, word: str) -> float:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = float(self.weights[word_features(word)].sum())
        return found

    def logit(self, sentence: str) -> float | None:
        """None where there is no word."""
        words = set(_WORDS(sentence))
        if not words:
            return None
        try:
            return self.bias + math.fsum(map(self.known.__getitem__, words))
        except KeyError:
            return self.bias + math.fsum(map(self.word, words))

    def level(self, sentences: int) -> float:
        """Logit beyond which a sentence counts in a text of so many."""
        return self.background.level(sentences) if self.background and sentences else -math.inf

    def score(self, text: str | None) -> float:
        """1 - prod(1 - p) over the sentences, of each what goes beyond the background."""
        found = [z for sentence in _SENTENCES.findall((text or "").lower()) if (z := self.logit(sentence)) is not None]
        level = self.level(len(found))
        return -math.expm1(-math.fsum(mass(z) - mass(level) for z in found if z > level))

    def locate(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and probability of the offending sentences, in code points."""
        found = [(m.start(), m.end(), z) for m in _SENTENCES.finditer(text or "") if (z := self.logit(m[0].lower())) is not None]
        level = self.level(len(found))
        rated = [(a, b, 1 / (1 + math.exp(-max(min(z, 500), -500)))) for a, b, z in found if z > level]
        return [x for x in rated if x[2] >= OFFENDING]


def mass(z: float) -> float:
    """-log(1 - p) of a sentence with logit z."""
    return z if z >= 30 else math.log1p(math.exp(z)) if z > -700 else 0.0


def train(texts: list[str | None], labels: list[int], steps: int = 150, rate: float = 0.15, penalty: float = 1e-4) -> Model:
    """Fit a model to labelled texts: Adam over the whole sample, every step exact.

    Weights stay at 0 or above and pay ``penalty`` for their sum: a word can be evidence of offence, none excuses another,
    and what occurs in offensive documents by chance gets no weight.
    """
    y = np.array(labels, np.float64)
    ids: dict[str, int] = {}
    tokens, sentence_ends, document_ends, kept = [], [], [], []
    for k, text in enumerate(texts):
        n = len(sentence_ends)
        for sentence in _SENTENCES.findall((text or "").lower()):
            if words := set(_WORDS(sentence)):
                tokens += sorted(ids.setdefault(w, len(ids)) for w in words)
                sentence_ends.append(len(tokens))
        if len(sentence_ends) > n:
            document_ends.append(len(sentence_ends))
            kept.append(k)
    y = y[kept]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES, np.float32), -60.0)
    token = np.array(tokens, np.int64)
    features = [word_features(w) for w in ids]
    place = np.fromiter((f for fs in features for f in fs), np.int64)
    width = np.array([len(f) for f in features])
    word_at = np.concatenate([[0], np.cumsum(width)[:-1]])
    sentence_at = np.concatenate([[0], sentence_ends[:-1]]).astype(np.int64)
    sentence_of = np.repeat(np.arange(len(sentence_ends)), np.diff([0, *sentence_ends]))
    document_at = np.concatenate([[0], document_ends[:-1]]).astype(np.int64)
    document_of = np.repeat(np.arange(len(y)), np.diff([0, *document_ends]))
    weight, bias = np.zeros(FEATURES), -4.0
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for step in range(1, steps + 1):
        score = np.add.reduceat(weight[place], word_at)
        z = bias + np.add.reduceat(score[token], sentence_at)
        mass = np.add.reduceat(np.logaddexp(0, z), document_at)
        # d loss / d mass: 1 for label 0, -1/(e^mass - 1) for label 1
        pull = np.where(y == 1, -1 / np.expm1(np.clip(mass, 1e-9, 50)), 1.0) * share
        pull = np.clip(pull, -1.0, 1.0)
        at_sentence = pull[document_of] / (1 + np.exp(-np.clip(z, -50, 50)))
        at_word = np.bincount(token, weights=at_sentence[sentence_of], minlength=len(ids))
        grad = np.bincount(place, weights=np.repeat(at_word, width), minlength=FEATURES) + penalty
        grad_bias = at_sentence.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_bias, 0.99 * vb + 0.01 * grad_bias**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        weight = np.maximum(weight - rate * (m / fix) / (np.sqrt(v / fix2) + 1e-6), 0.0)
        bias -= rate * (mb / fix) / (math.sqrt(vb / fix2) + 1e-6)
    score = np.add.reduceat(weight[place], word_at)
    z = bias + np.add.reduceat(score[token], sentence_at)
    return Model(weight.astype(np.float32), float(bias), Background.of(z[y[document_of] == 0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, per_class: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``per_class`` training rows of each label: those with the smallest hashed ids.

    Rows whose crc32(id) mod ``modulus`` is ``left_out``, and rows without id or label, are never among them.  The sample's
    size is bounded by the parameter, so it is the one thing here that goes to the driver and is broadcast.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != left_out))
    rows = rows.groupBy(F.col("doc_id").alias("k")).agg(F.max(label).cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(picked), "k")
    # copies of a row count once; the order is fixed, so that training is
    found = texts.groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").collect()
    return [r["t"] for r in found], [r["y"] for r in found]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Train on the labels' own training rows: never on those whose crc32(id) mod 3 is 1."""
    return train(*labelled_sample(docs, labels, "toxic", 3, 1, per_class))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and offending (start, end, probability of sentences) of every whole text; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in source:
            texts = batch.column(1).to_pylist()
            scores = [own.score(t) for t in texts]
            where = [[dict(zip(("start", "end", "probability"), x, strict=True)) for x in own.locate(t)] if s >= OFFENDING else [] for t, s in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(where, span)],
                ["doc_id", "score", "predicted", "offending"],
            )
        own.known.clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, score double, predicted int, offending array<struct<start:bigint,end:bigint,probability:double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in source:
            yield batch.filter(pa.array([own.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))
        own.known.clear()

    return docs.mapInArrow(giving_back(batches), docs.schema)


def op5_toxicity(spark, sf_dir):
    """Toxicity of every document, with the sentences that make it."""
    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "offending")
