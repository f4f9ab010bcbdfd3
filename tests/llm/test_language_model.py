"""The maximum-entropy model against plain versions of its counts and probabilities."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from jobledger.llm import maxent_lm as lm

LONG = " ".join(f"w{i % 700}" for i in range(200_000))
NAMES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def rows(seed=1):
    out = brute.corpus(seed, n=120)
    return [*[(d, f"{t or ''} only{d}", *r) for d, t, *r in out], *out, (2000, LONG, "en", "big"), (None, out[3][1], None, "small"), out[5], out[5], (out[7][0], "another TEXT under the same id", "en", None), (2001, "long" * 5000, "en", None), *[(i, "unseen words", "en", None) for i in range(3000, 3020)]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), brute.COLUMNS).repartition(3).persist()


@pytest.fixture
def few(monkeypatch):
    """A small table and small shards, so that every path is taken."""
    for name, value in {"TABLE": 300, "SHARD_TOKENS": 20_000, "FAN_IN": 2}.items():
        monkeypatch.setattr(lm, name, value)


def shown(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=lambda r: repr(r[:5]))


@pytest.mark.parametrize("table", [1 << 17, 300])
def test_counts_and_base_scores(spark, docs, monkeypatch, table):
    monkeypatch.setattr(lm, "TABLE", table)
    monkeypatch.setattr(lm, "ROUNDS", 1)
    found, want = shown(lm.score(docs)), sorted(brute.unigram_scores(rows())[0], key=lambda r: repr(r[:5]))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in found], [r[5] for r in want], rtol=1e-9)
    assert any(r[3] < r[2] for r in want) and any(r[1] for r in want)


def model_of(data, monkeypatch):
    """Words, leaves and a trained model made without Spark, by plain counting."""
    counts = Counter(w for _, t, *_ in data for w in (t or "").encode().lower().split())
    words = lm.Words.of(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm.TABLE], len(data))
    lookup = lm.Lookup(words)
    symbol = np.concatenate([words.symbols(), np.arange(lm.CONTEXTS, lm.CONTEXTS + lm.LEAVES)]).astype(np.uint16)
    packed = [symbol[[lookup[w] for w in [*(t or "").encode().lower().split(), b""]]].tobytes() for _, t, *_ in data]
    of_symbol = np.concatenate([words.leaves()[: lm.CONTEXTS], np.zeros(max(0, lm.CONTEXTS - len(words.words)), np.int64), np.arange(lm.LEAVES)])
    sizes = np.zeros((2, lm.LEAVES), np.int64)
    for word, n in [*counts.items(), (b"", len(data))]:
        place = lookup[word]
        leaf = words.leaves()[place] if place < len(words.words) else words.leaf(word)
        sizes[:, leaf] += n, 1
    pairs = np.zeros((lm.LEAVES, lm.LEAVES), np.int64)
    for p in packed:
        before = 0
        for s in np.frombuffer(p, np.uint16):
            pairs[of_symbol[before], of_symbol[s]] += 1
            before = s
    leaves = lm.Leaves(*sizes, *lm.classes(pairs), of_symbol)
    trainer = lm.Trainer(lm.Model.new(leaves))
    trainer.learn(packed)
    return words, counts, packed, leaves, lm.Model(leaves, trainer.model.weights, trainer.touched)


def test_probabilities_equal_the_plain_sums_and_add_up_to_one(monkeypatch):
    data = brute.corpus(2, n=40)
    words, counts, packed, leaves, model = model_of(data, monkeypatch)
    w, at = model.weights.astype(float), lm.OFFSETS

    def softmax(x):
        return np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def leaf_shares(one, two, three):
        """P(leaf | history), from the definition of the features."""
        first, second = leaves.of_symbol[one], leaves.of_symbol[two]
        classes = softmax(w[at[0] + one] + w[at[1] + first * 256 + second] + w[at[2] + two] + w[at[3] + three] + w[at[6]])
        out = np.zeros(lm.LEAVES)
        for c in range(lm.WAYS):
            hashed = ((int(one) * lm.WAYS + c) * 2654435761 >> 16) % 65536
            share = softmax(w[at[4] + hashed] + w[at[5] + c * lm.LEAVES + second] + w[at[7] + c])
            own = leaves.class_of == c
            out[own] = classes[c] * share[leaves.place_of[own]]
        return out

    assert all(np.bincount(leaves.class_of) == lm.WAYS)
    got = np.zeros(len(packed))
    for piece in lm.pieces(packed):
        got += np.bincount(piece[4], model.log10(piece), len(packed))
    for number in (0, 3, 17, 40, 41):
        history, total = [0, 0, 0], 0.0
        for s in np.frombuffer(packed[number], np.uint16):
            share = leaf_shares(history[-1], history[-2], history[-3])
            assert math.isclose(share.sum(), 1, rel_tol=1e-6)
            leaf = leaves.of_symbol[s]
            total += math.log10(share[leaf]) - math.log10(leaves.tokens[leaf] + leaves.distinct[leaf] + 1)
            history.append(s)
        assert math.isclose(got[number], total, rel_tol=1e-5)
    # In each leaf the known words and one unseen word share everything.
    assert leaves.tokens.sum() == sum(counts.values()) + len(data) and leaves.distinct.sum() == len(counts) + 1


def test_scores_are_better_than_unigrams_on_held_out_texts(spark, few):
    """Texts of two vocabularies whose words follow each other in a cycle."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        at, kind, step = int(rng.integers(0, 40)), "ab"[i % 2], []
        for _ in range(60):
            step.append(f"{kind}{at}")
            at = (at + 1) % 40 if rng.random() < 0.9 else int(rng.integers(0, 40))
        data.append((i, " ".join(step)))
    found = lm.score(spark.createDataFrame(data, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert found[0] / found[2] > found[1] / found[2] + 0.4


def test_several_shards_and_rounds(spark, docs, few, monkeypatch):
    """Reruns agree to the last digit; reading tokens in other pieces or adding moves up in other groups changes little."""
    first, again = shown(lm.score(docs)), shown(lm.score(docs))
    assert first == again
    monkeypatch.setattr(lm, "FAN_IN", 64)
    other = shown(lm.score(docs))
    assert np.allclose([r[6] for r in first], [r[6] for r in other], rtol=1e-4)
    assert all(r[6] < 0 and math.isfinite(r[6]) for r in first)
    equal = {}
    for r in first:
        equal.setdefault(r[:6], set()).add(r[6])
    assert max(len(v) for v in equal.values()) == 1


def test_odd_tables(spark):
    some = spark.createDataFrame(brute.corpus(4, n=10), brute.COLUMNS)
    assert lm.score(some.limit(0)).collect() == []
    nothing = spark.createDataFrame([(None, None), (None, ""), (None, " \n ")], "doc_id long, text string")
    # Three ends, all counted: one token of one kind.
    assert [r[:6] for r in shown(lm.score(nothing))] == [(None, False, 1, 1, 3, pytest.approx(math.log10(4 / 5)))] * 3
    unseen = spark.createDataFrame([(i, "a b") for i in range(60)], "doc_id long, text string").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    assert {r[1:6] for r in shown(lm.score(unseen))} == {(True, 3, 0, 0, 0.0)}
    names = ["row", "held_out", "word", "n", "rest", "symbols", "known", "logs", "more", "model", "shard", "score", "__key"]
    clashing = some.withColumns({c: F.lit("x") if i % 2 else F.lit(None).cast("date") for i, c in enumerate(names)})
    assert shown(lm.score(clashing)) == shown(lm.score(some))
