"""Language of a text by prediction by partial matching.

For each language, a tree of byte contexts of up to ``ORDER`` bytes counts which byte follows. A byte costs -log2 of its
share in the longest context that has it; every longer context that was seen without it costs an escape, whose
probability is d / (n + d) for d different bytes in n (method C). Contexts begin at the space before a word and the space
after it is the last byte, so a word costs the same wherever it stands, and the exact code length of a text is the sum
over its words. The language with the shortest code wins.

The trees are counted from at most about ``sample_rows`` texts per language (chosen by a hash of the id) and then frozen.
All languages share one sorted table per order with the finished code lengths; a task looks up different words only.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.llm.common import over_batches, slices, starts_of, texts
from jobledger.llm.substring_dedup import WordNumbers
from jobledger.llm.toxicity_nb import remainder

ORDER = 3
SLICE_BYTES = 8 << 20
UNKNOWN = "und"


def lowered(content: bytes) -> bytes:
    return content.decode("utf-8", "replace").lower().encode()


def stream(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words as bytes, each between two spaces, and where each begins."""
    return np.frombuffer(b"".join([b" %b " % w for w in words]), np.uint8).astype(np.int64), starts_of(np.fromiter(map(len, words), np.int64, len(words)) + 2)


def contexts(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are coded (all but the first of each word), and how many bytes of the word come before."""
    sizes = np.diff(np.append(begins, len(symbols)))
    depth = np.arange(len(symbols)) - np.repeat(begins, sizes)
    at = np.flatnonzero(depth)
    return at, depth[at]


def keys(symbols: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes before each position and the byte itself, as one number."""
    out = symbols[at].copy()
    for j in range(1, order + 1):
        out |= symbols[at - j] << (8 * j)
    return out


def _suffix(key: np.ndarray, order: int) -> np.ndarray:
    """The same byte in a context one byte shorter."""
    return key & ((1 << (8 * order)) - 1)


@dataclass(frozen=True)
class Trees:
    """Per order: sorted keys with code lengths (languages x keys), sorted contexts with escape lengths (languages x contexts)."""

    languages: list[str]
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def lengths(self, key: np.ndarray, order: int) -> np.ndarray:
        """Code lengths (languages x keys) of bytes whose longest usable context has ``order`` bytes."""
        if order < 0:
            return np.full((len(self.languages), len(key)), 8.0)
        out = np.empty((len(self.languages), len(key)))
        at = np.searchsorted(self.keys[order], key)
        at[at == len(self.keys[order])] = 0
        found = self.keys[order][at] == key if len(self.keys[order]) else np.zeros(len(key), bool)
        out[:, found] = self.bits[order][:, at[found]]
        rest = key[~found]
        if len(rest):
            below = self.lengths(_suffix(rest, order), order - 1)
            if len(self.contexts[order]):
                context = rest >> 8
                at = np.searchsorted(self.contexts[order], context)
                at[at == len(self.contexts[order])] = 0
                below += np.where(self.contexts[order][at] == context, self.escapes[order][:, at], 0.0)
            out[:, ~found] = below
        return out

    def words(self, words: list[bytes]) -> np.ndarray:
        """Code length of each word in each language (languages x words)."""
        symbols, begins = stream(words)
        at, depth = contexts(symbols, begins)
        out = np.zeros((len(self.languages), len(symbols)))
        for order in range(1, ORDER + 1):
            own = at[depth == order] if order < ORDER else at[depth >= order]
            if len(own):
                out[:, own] = self.lengths(keys(symbols, own, order), order)
        return np.add.reduceat(out, begins, axis=1) if len(words) else out


def grow(languages: list[str], rows: list[tuple[int, int, int, int]]) -> Trees:
    """Trees from counts (order, language, key, count)."""
    trees = Trees(languages, [], [], [], [])
    table = np.array(rows, np.int64).reshape(-1, 4)
    for order in range(ORDER + 1):
        part = table[table[:, 0] == order]
        key = np.unique(part[:, 2])
        context = np.unique(key >> 8)
        counts = np.zeros((len(languages), len(key)))
        counts[part[:, 1], np.searchsorted(key, part[:, 2])] = part[:, 3]
        of = np.searchsorted(context, key >> 8)
        total, kinds = np.zeros((2, len(languages), len(context)))
        for i in range(len(languages)):
            total[i] = np.bincount(of, counts[i], len(context))
            kinds[i] = np.bincount(of, counts[i] > 0, len(context))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
            own = np.log2((total + kinds)[:, of] / counts)
        below = trees.lengths(_suffix(key, order), order - 1) if len(key) else np.zeros_like(counts)
        bits = np.where(counts > 0, own, escape[:, of] + below)
        trees.keys.append(key), trees.bits.append(bits), trees.contexts.append(context), trees.escapes.append(escape)
    return trees


def train(docs: DataFrame, sample_rows: int = 1500, folds: int = 4, left_out: int = 2) -> Trees:
    """Learns from texts with a language whose fold is not ``left_out``; about ``sample_rows`` texts for each language."""
    usable = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(remainder("doc_id", folds) != left_out)
    # One row per language; the share that is read gives each language the same expected number of texts.
    sizes = dict(usable.groupBy("lang").count().collect())
    languages = sorted(sizes)
    if not languages:
        return grow([], [])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, sample_rows / sizes[lang])])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(place < share[F.col("lang")])
    number = {name: i for i, name in enumerate(languages)}

    def count(batches):
        tally: dict[int, Counter] = {}
        for batch in batches:
            for lang, content in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                tally.setdefault(number[lang], Counter()).update(lowered(content).split())
        for lang, words in tally.items():
            weight = np.fromiter(words.values(), np.int64, len(words))
            symbols, begins = stream(list(words))
            at, depth = contexts(symbols, begins)
            weight = np.repeat(weight, np.diff(np.append(begins, len(symbols))))
            for order in range(ORDER + 1):
                own = at[depth >= order]
                key, inverse = np.unique(keys(symbols, own, order), return_inverse=True)
                n = np.bincount(inverse, weight[own], len(key)).astype(np.int64)
                columns = [np.full(len(key), order), np.full(len(key), lang), key, n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["order", "lang", "key", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "order long, lang long, key long, n long")
    rows = counted.groupBy("order", "lang", "key").agg(F.sum("n").alias("n")).collect()
    return grow(languages, [tuple(r) for r in rows])


def predict(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (share of the winner if code lengths are read as likelihoods).

    Null texts, texts without any letter, and all texts if nothing was learned: ``und`` with score 0. Ties go to the
    language whose name comes first.
    """
    at = docs.columns.index(text)
    languages = trees.languages

    def compute(batch):
        contents = texts(batch.column(at))
        names, scores = [], []
        for a, b in slices(contents, SLICE_BYTES):
            split = [lowered(t).split() for t in contents[a:b]]
            number = WordNumbers()
            ids = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in split]
            cost = trees.words(list(number)) if languages else np.zeros((0, 0))
            for content, own in zip(contents[a:b], ids):
                if not languages or not any(map(str.isalpha, content.decode("utf-8", "replace"))):
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                bits = cost[:, own].sum(axis=1)
                best = int(bits.argmin())
                names.append(languages[best]), scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -60)).sum()))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return over_batches(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], compute)
