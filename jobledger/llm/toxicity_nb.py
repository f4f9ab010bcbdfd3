"""Toxic text: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning 2012).

A feature is whether an n-gram of code points occurs inside any word of the whole text (words carry a mark at both ends).
Its value is the log ratio of how many toxic and how many other training texts have it; logistic regression learns the
weights on top. Ratios and weights come from at most ``sample_rows`` labelled rows per class, taken in the order of a hash
of the id, so the model has a fixed size; scoring is one pass over all texts without a shuffle. Since features belong to
words, a task looks each different word up once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.llm.common import over_batches, settle, starts_of, texts

SIZES = range(3, 7)
FEATURES = 4096
SMOOTHING = 0.5
PENALTY = 1e-3
STEPS = 200


def remainder(name: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id belongs to no fold (-1)."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % folds, F.lit(-1))


def grams(word: bytes) -> set[str]:
    marked = f"^{word.decode('utf-8', 'replace').lower()}$"
    return {marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1)}


@dataclass(frozen=True)
class Model:
    """Weight of each n-gram (log-count ratio times learned weight) and intercept."""

    weights: dict[str, float]
    bias: float


class WordFeatures(dict):
    """The model's n-grams in a word; remembered, and forgotten as a whole when there are too many words."""

    def __init__(self, known: dict[str, object], most: int = 300_000):
        self.known, self.most = known, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        found = self[word] = tuple(g for g in grams(word) if g in self.known) or None
        return found

    def of(self, content: bytes) -> set[str]:
        found: set[str] = set()
        for features in map(self.__getitem__, set(content.split())):
            if features:
                found.update(features)
        return found


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, folds: int, left_out: int) -> tuple[DataFrame, int, int]:
    """At most ``sample_rows`` texts of each class outside the fold, and how many of each class there are."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(remainder("doc_id", folds) != left_out)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    chosen = [
        known.where(F.col("toxic") == c).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for c in (0, 1)
    ]
    # Two times sample_rows pairs of numbers: a proven bound.
    picked = F.broadcast(chosen[0].union(chosen[1]))
    found = settle(docs.select("doc_id", "text").join(picked, "doc_id"), "labelled-texts")
    # Ids may repeat: the bound holds for rows.
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    some = [found.where(F.col("toxic") == c).orderBy(*order).limit(sample_rows) for c in (0, 1)]
    rows = some[0].union(some[1]).select("text", "toxic")
    return settle(rows, "labelled-sample"), counts.get(0, 0), counts.get(1, 0)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, folds: int = 5, left_out: int = 0) -> Model:
    """Learns from labelled rows whose fold is not ``left_out``. Without rows of both classes the model is their share alone."""
    rows, n_clean, n_toxic = training_rows(docs, labels, sample_rows, folds, left_out)
    prior = float(np.log((n_toxic + SMOOTHING) / (n_clean + SMOOTHING)))
    if not n_clean or not n_toxic:
        return Model({}, prior)

    def count(batches):
        tally: tuple[Counter, Counter] = (Counter(), Counter())
        memory: dict[bytes, set[str]] = {}
        for batch in batches:
            for content, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                found: set[str] = set()
                for word in set(content.split()):
                    if word not in memory:
                        if len(memory) >= 100_000:
                            memory.clear()
                        memory[word] = grams(word)
                    found |= memory[word]
                tally[toxic > 0].update(found)
                if len(tally[0]) + len(tally[1]) > 1_000_000:
                    yield from emit(tally)
        yield from emit(tally)

    def emit(tally):
        for c, part in enumerate(tally):
            if part:
                n = np.fromiter(part.values(), np.int64, len(part))
                zero = np.zeros(len(part), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(part), pa.string()), pa.array(zero if c else n), pa.array(n if c else zero)], names=["gram", "clean", "toxic"])
            part.clear()

    sizes = dict(rows.groupBy("toxic").count().collect())
    a = SMOOTHING
    counted = rows.mapInArrow(count, "gram string, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + a) / (sizes.get(1, 0) + 2 * a)) - F.log((F.col("clean") + a) / (sizes.get(0, 0) + 2 * a))
    best = counted.where("clean + toxic >= 3").withColumn("ratio", ratio)
    best = best.orderBy(F.desc(F.abs("ratio") * F.sqrt(F.col("clean") + F.col("toxic"))), "gram").limit(FEATURES).select("gram", "ratio").collect()
    if not best:
        return Model({}, prior)
    ratios = {r["gram"]: r["ratio"] for r in best}
    number = {g: i for i, g in enumerate(ratios)}

    def features(batches):
        of = WordFeatures(number)
        for batch in batches:
            found = [sorted(number[g] for g in of.of(t)) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    matrix = rows.mapInArrow(features, "toxic int, found array<int>").collect()
    # Rows come in the order of the stored files; sums must not depend on it.
    matrix = sorted((r["toxic"], r["found"]) for r in matrix)
    weights, bias = _regress(matrix, np.array(list(ratios.values())))
    balance = np.log((sizes.get(1, 0) + a) / (sizes.get(0, 0) + a))
    return Model({g: float(r * w) for (g, r), w in zip(ratios.items(), weights) if r * w}, float(bias - balance + prior))


def _regress(matrix: list[tuple[int, list[int]]], ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a square penalty, by adaptive gradient steps."""
    y = np.array([t for t, _ in matrix], float)
    counts = np.array([len(f) for _, f in matrix], np.int64)
    own = np.flatnonzero(counts)
    column = np.array([j for _, f in matrix for j in f], np.int64)
    row = np.repeat(np.arange(len(matrix)), counts)
    value = ratios[column] / max(1e-9, np.abs(ratios).max()) if len(column) else np.zeros(0)
    w, b = np.zeros(len(ratios)), 0.0
    gw, gb = np.full(len(ratios), 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.full(len(y), b)
        if len(own):
            z[own] += np.add.reduceat(value * w[column], starts_of(counts[own]))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(column, value * error[row], len(w)) / len(y) + PENALTY * w
        gw, gb = gw + g * g, gb + error.mean() ** 2
        w, b = w - 0.3 * g / np.sqrt(gw), b - 0.3 * error.mean() / np.sqrt(gb)
    return w / max(1e-9, np.abs(ratios).max()), b


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability of the toxic class. Null and empty texts have no feature: the intercept decides."""
    at = docs.columns.index(text)

    def compute(batch, memory=[]):  # noqa: B006  one table of words per Python worker
        if not memory:
            memory.append(WordFeatures(model.weights))
        sums = [sum(sorted(map(model.weights.__getitem__, memory[0].of(t)))) for t in texts(batch.column(at))]
        z = np.clip(np.array(sums, float) + model.bias, -30, 30)
        return [pa.array(1 / (1 + np.exp(-z)), pa.float64())]

    return over_batches(docs, [T.StructField(column, T.DoubleType())], compute)
