"""Quality by Bradley-Terry ranking.

Each preference pair is a training document labelled good and one labelled bad; the good one should win.  The score is
linear in features of the text, and the logistic loss on the pairs' feature differences gives the weights, so nothing but
the order within pairs is learned.  Features are measures of the text's form and its content: hashed words and pairs of
neighbouring words, each text's of unit length.  The cut is a quantile of the training scores: that of the bad documents'
share.  Scores are shifted and squashed so that the cut is at ``THRESHOLD``.

Training takes every labelled training row: they are dealt into blocks of about ``BLOCK``, each block gives weights from ``PAIRS``
pairs of its own, and these are averaged.  A label that is too rare for its rows to reach all blocks has them in as many as it
takes.  The measures' centres and scales, and the cut, are those of all training rows.  Scoring takes every text whole.

Defined results: null texts are scored like empty ones; without both labels in the training rows every score is 0.5; repeated rows
are scored alike and stay repeated; equal scores at the quantile fall on one side of it; extra columns are kept by
:func:`keep_good` and not returned by :func:`score`.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, giving_back, materialize, remainder, table

#: Training rows of a block, rows of each label that a block should have, preference pairs of a block.
BLOCK, EACH, PAIRS = 4000, 200, 60_000
#: Score from which a document counts as good, parts of which one is 1 when weights are summed as whole numbers.
THRESHOLD, PARTS = 0.3, 10**9
#: Hashed content features, words whose place a worker remembers, steps of training, weight of the penalty.
HASHED, REMEMBERED, STEPS, PENALTY = 1 << 16, 300_000, 150, 1e-3

_DIGITS = re.compile(r"\d")
_SYMBOLS, _STOPS = "#*$%&<>", ".,;:"


def features(text: str | None) -> list[float]:
    """Measures of a whole text; shares are per word, and squashed so that none dominates."""
    text = text or ""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    per = lambda k: math.log1p(20 * k / max(n, 1))
    distinct = len(set(words))
    bigrams = len(set(zip(words, words[1:], strict=False)))
    upper = sum(map(str.isupper, words))
    count = text.count
    return [
        math.log1p(n),
        math.log1p(len(text)) - math.log1p(n),
        per(sum(map(count, _SYMBOLS))),
        per(count("|")),
        per(count("!")),
        per(sum(map(count, _STOPS))),
        per(upper),
        per(sum(map(operator.eq, words, words[1:]))),
        per(max(0, n - 1 - bigrams)),
        math.log1p(distinct) / math.log1p(n) if n else 1.0,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        per(len(_DIGITS.findall(text)) if any(map(count, "0123456789")) else 0),
        float(n == 0),
    ]


_places: dict[str, int] = {}


def content(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a whole text's content features: how often words and pairs of neighbours occur, as logarithms, scaled to
    unit length."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    try:
        one = np.array([_places[w] for w in words], np.int64)
    except KeyError:
        if len(_places) > REMEMBERED:
            _places.clear()
        one = np.array([_places.setdefault(w, zlib.crc32(w.encode("utf-8", "surrogatepass"))) for w in words], np.int64)
    two = (one[:-1] * 0x9E3779B1 + one[1:] * 0x85EBCA6B + 1) >> 7
    places, counts = np.unique(np.concatenate([one % HASHED, two % HASHED]), return_counts=True)
    values = np.log1p(counts)
    return places, values / math.sqrt(float(values @ values))


@dataclass
class Model:
    """Centre and scale of the measures, their weights and those of the content, and the score at the cut."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    hashed: np.ndarray
    cut: float

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Bradley-Terry scores of texts."""
        x = (np.array([features(t) for t in texts], np.float64).reshape(-1, len(self.centre)) - self.centre) / self.scale
        own = [float(self.hashed[places] @ values) for places, values in map(content, texts)]
        return np.clip(x, -6, 6) @ self.weights + np.array(own, np.float64)

    def scores(self, texts: list[str | None]) -> list[float]:
        z = self.raw(texts) - self.cut + math.log(THRESHOLD / (1 - THRESHOLD))
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def train(
    texts: list[str | None], labels: list[int], bad_share: float, pairs: int = PAIRS, penalty: float = PENALTY, steps: int = STEPS, form: tuple[np.ndarray, np.ndarray] | None = None
) -> Model:
    """Fit to labelled texts; ``bad_share`` is the share of bad documents among all training rows, ``form`` centre and scale of the
    measures, if not those of these texts."""
    width = len(features(""))
    rows = np.array([features(t) for t in texts], np.float64).reshape(len(texts), width)
    y = np.array(labels)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros(HASHED), math.log(THRESHOLD / (1 - THRESHOLD)))
    model = Model(*(form or (rows.mean(0), rows.std(0) + 1e-6)), np.zeros(width), np.zeros(HASHED), 0.0)
    x = np.clip((rows - model.centre) / model.scale, -6, 6)
    found = [(places.astype(np.int32), values.astype(np.float32)) for places, values in map(content, texts)]
    # entries by document for scores, and by place for gradients, so that both are sums of runs
    sizes = np.array([len(f[0]) for f in found])
    places, values = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    del found
    order = np.argsort(places, kind="stable")
    owner, turned = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[order], values[order]
    held, used = np.flatnonzero(sizes), np.unique(places)
    by_text, by_place = (np.cumsum(sizes) - sizes)[held], np.searchsorted(places[order], used)
    del order
    rng = np.random.default_rng(7)
    n = min(pairs, len(good) * len(bad))
    winner, loser = rng.choice(good, n), rng.choice(bad, n)

    def score(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        own = x @ w
        if len(held):
            own[held] += np.add.reduceat(v.astype(np.float32)[places] * values, by_text)
        return own

    # the pairs' logistic loss on score differences, whose gradient is first summed by document; steps of Adam on all pairs
    weights = np.zeros(width + HASHED)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        s = score(weights[:width], weights[width:])
        lost = 1 / (1 + np.exp(np.clip(s[winner] - s[loser], -50, 50))) / n
        pull = np.bincount(loser, lost, len(texts)) - np.bincount(winner, lost, len(texts))
        grad = np.concatenate([pull @ x, np.zeros(HASHED)]) + penalty * weights
        if len(used):
            grad[width + used] += np.add.reduceat(pull.astype(np.float32)[owner] * turned, by_place)
        mean += 0.1 * (grad - mean)
        square += 0.001 * (grad**2 - square)
        weights -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    model.weights, model.hashed = weights[:width], weights[width:]
    shares = np.where(y == 1, (1 - bad_share) / len(good), bad_share / len(bad))
    model.cut = weighted_quantile(score(model.weights, model.hashed), shares, bad_share)
    return model


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The value midway between the last whose cumulated weight is within ``share`` and the next."""
    order = np.argsort(values, kind="stable")
    k = int(np.searchsorted(np.cumsum(weights[order]) / weights.sum(), share + 1e-12))
    ordered = values[order]
    return float((ordered[max(k - 1, 0)] + ordered[min(k, len(ordered) - 1)]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """k, t and y: id, text and label of every training row, of copies one; never of those whose crc32(id) mod 5 is 0."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    rows = rows.groupBy(F.col("doc_id").alias("k")).agg(F.max("quality").cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).join(rows, "k")
    return texts.groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y"))


def dealt(rows: DataFrame, counts: dict[int, int], block: int = BLOCK) -> tuple[DataFrame, int]:
    """block, k, t and y of training rows, and the number of blocks; rows of a rare label go to several, so that each block has some."""
    blocks = max(1, round(sum(counts.values()) / block))
    copies = {y: max(1, min(blocks, math.ceil(EACH * blocks / n))) for y, n in counts.items()}
    most = F.when(F.col("y") == 1, copies[1]).otherwise(copies[0])
    at = F.explode(F.sequence(F.lit(0), most - 1)).alias("copy")
    return rows.select("k", "t", "y", at).select(F.pmod(F.xxhash64("k") + F.col("copy"), F.lit(blocks)).cast("int").alias("block"), "k", "t", "y"), blocks


def nth(ranks: DataFrame, n: int) -> int:
    """The ``n``-th least, from 0, of whole numbers (rank): 16 bits a round, by counts."""
    found, rest = None, ranks
    for shift in (48, 32, 16, 0):
        own = rest.groupBy(F.shiftright("rank", shift).alias("head")).count().orderBy("head").collect()
        for head, count in own:
            if n < count:
                break
            n -= count
        found, rest = head, rest.where(F.shiftright("rank", shift) == head)
    return found


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; the same function turns them back, as :func:`value` has it."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def value(rank: int) -> float:
    bits = np.array([rank], np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> Model:
    """Train on all of the labels' own training rows: never on those whose crc32(id) mod 5 is 0."""
    rows = materialize(training_rows(docs, labels), "training")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        discard(rows)
        return train([], [], 0.0)
    width = len(features(""))

    def measures(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], ["x"])

    each = rows.select("t").mapInArrow(giving_back(measures), "x array<double>")
    found = each.agg(*(f(F.col("x")[k]) for f in (F.avg, F.stddev_pop) for k in range(width))).first()
    # sums of doubles depend on their order in the last digits
    form = np.round(found[:width], 9), np.round(found[width:], 9) + 1e-6

    def trained(table_: pa.Table) -> pa.Table:
        own = table_.sort_by("k")
        model = train(own.column("t").to_pylist(), own.column("y").to_pylist(), 0.5, form=form)
        parts = np.rint(np.concatenate([model.weights, model.hashed]) * PARTS).astype(np.int64)
        places = np.flatnonzero(parts)
        _places.clear()
        return pa.table({"place": pa.array(places, pa.int32()), "parts": pa.array(parts[places])})

    def weights(table_: pa.Table) -> pa.Table:
        out = trained(table_)
        give_back()
        return out

    own, blocks = dealt(rows, counts, block)
    sums = own.groupBy("block").applyInArrow(weights, "place int, parts long").groupBy("place").agg(F.sum("parts")).collect()
    all_ = np.zeros(width + HASHED)
    for place, parts in sums:
        all_[place] = parts / (PARTS * blocks)
    model = Model(*form, all_[:width], all_[width:], 0.0)
    shared = spark.sparkContext.broadcast(model)

    def scored(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([pa.array(ordered(shared.value.raw(batch.column(0).to_pylist())))], ["rank"])
        _places.clear()

    # the cut is midway between the last score within the bad rows' share and the next
    ranks = materialize(rows.select("t").mapInArrow(giving_back(scored), "rank long"), "ranks")
    below = nth(ranks, counts[0] - 1)
    above = nth(ranks, counts[0])
    for table_ in (ranks, rows):
        discard(table_)
    model.cut = (value(below) + value(above)) / 2
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every whole text; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            scores = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])
        _places.clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, whose text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield batch.filter(pa.array([s >= threshold for s in shared.value.scores(batch.column(at).to_pylist())], pa.bool_()))
        _places.clear()

    return docs.mapInArrow(giving_back(batches), docs.schema)


def op8_quality_classifier(spark, sf_dir):
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
