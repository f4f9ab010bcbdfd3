"""Language model scores: a hashed maximum-entropy model with a class-factored softmax.

Tokens are words with A-Z lower-cased and one end per text. A token's probability has three factors:

    P(class | history) * P(leaf | class, history) * P(word | leaf)

There are 16 classes of 16 leaves. The first two factors are softmaxes over sums of weights of hashed features: the word
before (n-gram), the two words before (trigram, by leaves), and the second and third word before alone (skips). The last is
(c + 1) / (tokens + distinct words + 1) over the training words of the leaf, so that all probabilities add up to one with
one share left in each leaf for unseen words.

How it is made, all of it from all training texts:

1. Words are counted; the counts are a table (``word``, ``n``) of any size.
2. The most frequent words, at most ``TABLE``, go to every task. The most frequent have a leaf each; all other words, seen or not,
   belong to a range of endings, cut so that ranges have equal shares. Leaves that keep the same company form a class.
3. One pass turns texts into two bytes a token and lists the words outside the table; these meet the counts in a join.
4. Tokens are dealt to shards of about ``SHARD_TOKENS``. In each of ``ROUNDS`` rounds a share of the shards trains from the
   common weights in minibatches; what a shard added to a row of weights is averaged over the shards that saw the row, by
   how often. Sums are made in the order of shards, a few at a time, so they do not depend on the cluster.
5. Scoring is one pass over the two-byte tokens.

Weights, classes and the table have a fixed size; counts, tokens and gradients grow with the texts and stay distributed.

Defined results
    * Null, empty and blank texts are one token, the end. Very long texts are worked on in pieces.
    * A null ``doc_id`` is in no fold, so its text trains. Rows that repeat are counted and scored each.
    * Without training texts every count is 0: ``base_score`` is 0 and ``score`` comes from equal weights.
    * Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.common import merge_packed, settle, slices, starts_of, texts
from jobledger.llm.toxicity_nb import remainder

TABLE = 1 << 17
LONGEST = 64  # bytes of a word in the table
WAYS = 16  # classes, and leaves of a class
LEAVES = WAYS * WAYS
OWN_LEAVES = 96
CONTEXTS = 4096  # words that are contexts of their own; other words stand for their leaf
SYMBOLS = CONTEXTS + LEAVES
END = 0  # symbol of the end of a text, which also stands before its beginning
SHARD_TOKENS = 4_000_000
ROUNDS = 3
MINIBATCH = 1 << 14
PIECE = 1 << 16
RATE = 0.7
# Squared gradients a row is taken to have had: at first, and for each time it was seen in an earlier round.
SQUARES, SQUARES_SEEN = 16.0, 0.3
FAN_IN = 32
SLICE_BYTES = 4 << 20
DISTINCT_AT_ONCE = 400_000

# Rows of weights per feature, WAYS weights each: class by word before, by two leaves before, by second and third word
# before; leaf by (class, word before) and (class, leaf of the second word before); then the two kinds of constants.
SIZES = (SYMBOLS, 1 << 16, SYMBOLS, SYMBOLS, 1 << 16, WAYS * LEAVES, 1, WAYS)
OFFSETS = starts_of(np.array(SIZES))
N_ROWS = sum(SIZES)
OF_CLASS, OF_LEAF = (0, 1, 2, 3), (4, 5)
BLOCK = 2048


def tokens(content: bytes) -> list[bytes]:
    return content.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(``word``, ``n``) over the training texts; the end of a text is the empty word."""

    def count(batches):
        tally: Counter = Counter()
        for batch in batches:
            contents = texts(batch.column(0))
            tally[b""] += len(contents)
            for content in contents:
                tally.update(tokens(content))
                if len(tally) > DISTINCT_AT_ONCE:
                    yield _counted(tally)
                    tally = Counter()
        if tally:
            yield _counted(tally)

    found = docs.where("NOT held_out").select("text").mapInArrow(count, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _counted(tally: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])


def frequent_words(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most ``TABLE`` words by falling count: all with at least the count that leaves no more than that."""
    short = counts.where(F.length("word").between(1, LONGEST)).withColumn("size", F.floor(F.log2("n") * 256))
    left, least = TABLE, None
    for row in short.groupBy("size").count().orderBy(F.desc("size")).collect():  # 256 rows for each doubling of a count
        left -= row["count"]
        if left < 0:
            break
        least = row["size"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in short.where(F.col("size") >= least).collect()), key=lambda w: (-w[1], w[0]))


@dataclass(frozen=True)
class Words:
    """The table of frequent words (the end first) with their counts, and where ranges of endings begin."""

    words: list[bytes]
    counts: list[int]
    endings: list[bytes]

    @classmethod
    def of(cls, frequent: list[tuple[bytes, int]], ends: int) -> Words:
        """From words by falling count, without the end, which has come ``ends`` times."""
        others = sorted((w[::-1], n) for w, n in frequent[OWN_LEAVES - 1 :])
        ranges, total, seen, endings = LEAVES - OWN_LEAVES, sum(n for _, n in others), 0, []
        for word, n in others:
            if seen * ranges >= len(endings) * total and len(endings) < ranges:
                endings.append(word)
            seen += n
        return cls([b"", *[w for w, _ in frequent]], [ends, *[n for _, n in frequent]], endings)

    def leaf(self, word: bytes) -> int:
        """Of a word that has none of its own."""
        return OWN_LEAVES + max(0, bisect_right(self.endings, word[::-1]) - 1)

    def leaves(self) -> np.ndarray:
        """Leaf of each word of the table."""
        own = min(OWN_LEAVES, len(self.words))
        return np.array([*range(own), *map(self.leaf, self.words[own:])], np.int64)

    def symbols(self) -> np.ndarray:
        return np.where(np.arange(len(self.words)) < CONTEXTS, np.arange(len(self.words)), CONTEXTS + self.leaves()).astype(np.uint16)


class Lookup(dict):
    """Place of each word in the table; words outside it get the table's size plus their leaf."""

    def __init__(self, words: Words):
        super().__init__({w: i for i, w in enumerate(words.words)})
        self.of, self.size = words, len(words.words)

    def __missing__(self, word: bytes) -> int:
        return self.size + self.of.leaf(word)


def encode(rows: DataFrame, words: Words) -> DataFrame:
    """Tokens as symbols of two bytes, sums over the words in the table, and the ``rest``: words outside it with numbers."""
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        lookup = Lookup(sent.value)
        size = lookup.size
        symbol = np.concatenate([sent.value.symbols(), np.arange(CONTEXTS, SYMBOLS).astype(np.uint16)])
        counts = np.concatenate([np.array(sent.value.counts, np.int64), np.zeros(LEAVES, np.int64)])
        logs = np.log10(counts + 1.0)
        for batch in batches:
            contents = texts(batch.column(3))
            for a, b in slices(contents, SLICE_BYTES):
                packed, n, known, sums, outside, often, sizes = [], [], [], [], [], [], []
                for content in contents[a:b]:
                    split = tokens(content)
                    split.append(b"")
                    places = np.fromiter(map(lookup.__getitem__, split), np.int64, len(split))
                    rest = Counter([split[i] for i in np.flatnonzero(places >= size).tolist()])
                    outside.extend(rest)
                    often.extend(rest.values())
                    sizes.append(len(rest))
                    packed.append(symbol[places].tobytes())
                    n.append(len(split))
                    known.append(int(np.count_nonzero(counts[places])))
                    sums.append(float(logs[places].sum()))
                entries = pa.StructArray.from_arrays([pa.array(outside, pa.binary()), pa.array(often, pa.int64())], names=["word", "n"])
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), entries)
                same = [batch.column(i).slice(a, b - a) for i in range(3)]
                new = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(packed, pa.binary()), listed]
                yield pa.RecordBatch.from_arrays([*same, *new], names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "symbols", "rest"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, symbols binary, rest array<struct<word: binary, n: long>>"
    return rows.select("row", "doc_id", "held_out", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Leaves:
    """Of each leaf: training tokens, distinct training words, class and place in the class; and the leaf of each symbol."""

    tokens: np.ndarray
    distinct: np.ndarray
    class_of: np.ndarray
    place_of: np.ndarray
    of_symbol: np.ndarray


def _integers(found: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of packed integer arrays, one from each task."""
    parts = merge_packed(found, lambda packed: sum((np.frombuffer(p, np.int64) for p in packed), np.zeros(math.prod(shape), np.int64)).tobytes())
    return np.frombuffer(parts, np.int64).reshape(shape) if parts else np.zeros(shape, np.int64)


def _packed(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["packed"])


def leaf_sizes(counts: DataFrame, words: Words) -> np.ndarray:
    """Training tokens and distinct training words of each leaf."""
    sent = counts.sparkSession.sparkContext.broadcast(words)

    def add(batches):
        own = dict(zip(sent.value.words, sent.value.leaves().tolist()))
        total = np.zeros((2, LEAVES), np.int64)
        for batch in batches:
            found = batch.column(0).to_pylist()
            leaves = np.fromiter((own[w] if w in own else sent.value.leaf(w) for w in found), np.int64, len(found))
            np.add.at(total[0], leaves, batch.column(1).to_numpy())
            total[1] += np.bincount(leaves, minlength=LEAVES)
        yield _packed(total)

    return _integers(counts.select("word", "n").mapInArrow(add, "packed binary"), (2, LEAVES))


def leaf_pairs(encoded: DataFrame, of_symbol: np.ndarray) -> np.ndarray:
    """How often each leaf follows each other one in the training texts."""

    def add(batches):
        total = np.zeros(LEAVES * LEAVES, np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0).to_pylist()):
                total += np.bincount(of_symbol[piece[1]].astype(np.int64) * LEAVES + of_symbol[piece[0]], minlength=LEAVES * LEAVES)
        yield _packed(total)

    return _integers(encoded.where("NOT held_out").select("symbols").mapInArrow(add, "packed binary"), (LEAVES, LEAVES))


def classes(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each leaf and its place there: leaves with alike neighbours are kept together, by halving along the main
    direction in which their neighbours differ until groups have ``WAYS`` leaves."""
    company = np.concatenate([pairs, pairs.T], axis=1).astype(float)
    company = np.sqrt(company / np.maximum(1, company.sum(axis=1, keepdims=True)))
    groups = [np.arange(LEAVES)]
    while len(groups) < WAYS:
        halves = []
        for group in groups:
            beside = company[group] - company[group].mean(axis=0)
            direction = np.linalg.svd(beside, full_matrices=False)[2][0]
            direction = direction * (1 if direction[np.abs(direction).argmax()] >= 0 else -1)
            order = group[np.argsort((beside @ direction).round(9), kind="stable")]
            halves += [np.sort(order[: len(order) // 2]), np.sort(order[len(order) // 2 :])]
        groups = halves
    class_of, place_of = np.empty((2, LEAVES), np.int64)
    for c, group in enumerate(groups):
        class_of[group], place_of[group] = c, np.arange(len(group))
    return class_of.astype(np.int64), place_of.astype(np.int64)


def pieces(packed: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of some texts, at most ``PIECE`` at a time: the token, the one, two and three before, and its text's number."""
    for first, last in slices(packed, 8 * PIECE):
        lengths = np.array([len(p) // 2 for p in packed[first:last]], np.int64)
        of = np.repeat(np.arange(last - first), lengths)
        flat = np.full(int(lengths.sum()) + 3 * (last - first), END, np.uint16)
        at = np.arange(len(of)) + 3 * (of + 1)
        flat[at] = np.frombuffer(b"".join(packed[first:last]), np.uint16)
        for a in range(0, len(of), PIECE):
            here = at[a : a + PIECE]
            yield flat[here], flat[here - 1], flat[here - 2], flat[here - 3], of[a : a + PIECE] + first


class Model:
    """Weights and how often each row of them was seen."""

    def __init__(self, leaves: Leaves, weights: np.ndarray, seen: np.ndarray):
        self.leaves, self.weights, self.seen = leaves, weights, seen
        self.denominators = np.log10(leaves.tokens + leaves.distinct + 1.0)

    @classmethod
    def new(cls, leaves: Leaves) -> Model:
        """Constants from the shares of classes and leaves, all other weights 0."""
        weights = np.zeros((N_ROWS, WAYS), np.float32)
        share = np.zeros((WAYS, WAYS))
        share[leaves.class_of, leaves.place_of] = leaves.tokens + 0.5
        weights[OFFSETS[6]] = np.log(share.sum(axis=1) / share.sum())
        weights[OFFSETS[7] :] = np.log(share / share.sum(axis=1, keepdims=True))
        return cls(leaves, weights, np.zeros(N_ROWS, np.int64))

    def features(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        """Row of each feature within its own range; ``of`` are the classes of the tokens."""
        leaf = self.leaves.of_symbol
        first, second = leaf[one].astype(np.uint32), leaf[two].astype(np.uint32)
        by_class = (one.astype(np.uint32) * WAYS + of) * np.uint32(2654435761) >> np.uint32(16)
        return [one, (first << np.uint32(8) | second).astype(np.uint16), two, three, by_class.astype(np.uint16), (of * LEAVES + second).astype(np.uint16)]

    def logits(self, found: list[np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        by_class, by_leaf = w[OFFSETS[0] + found[0]], w[OFFSETS[7] + of]
        for k in OF_CLASS[1:]:
            by_class += w[OFFSETS[k] + found[k]]
        by_class += w[OFFSETS[6]]
        for k in OF_LEAF:
            by_leaf += w[OFFSETS[k] + found[k]]
        return by_class, by_leaf

    def log10(self, piece: tuple[np.ndarray, ...]) -> np.ndarray:
        """Of each token: log10 of P(class) P(leaf | class), less the denominator of P(word | leaf)."""
        leaf = self.leaves.of_symbol[piece[0]]
        of, place = self.leaves.class_of[leaf], self.leaves.place_of[leaf]
        found = self.features(*piece[1:4], of)
        out = np.zeros(len(of))
        for x, y in zip(self.logits(found, of), (of, place)):
            top = x.max(axis=1)
            out += x[np.arange(len(y)), y] - top - np.log(np.exp(x - top[:, None]).sum(axis=1))
        return out / math.log(10) - self.denominators[leaf]


class Trainer:
    """Gradient steps on the tokens of one shard, from the common weights; a row's steps shrink with its squared gradients."""

    def __init__(self, model: Model):
        self.base, self.model = model, Model(model.leaves, model.weights.copy(), model.seen)
        self.squares = (SQUARES + SQUARES_SEEN * model.seen).astype(np.float32)
        self.touched = np.zeros(N_ROWS, np.int64)
        self.random = np.random.default_rng(11)

    def learn(self, packed: list[bytes]) -> None:
        for piece in pieces(packed):
            order = self.random.permutation(len(piece[0]))
            for a in range(0, len(order), MINIBATCH):
                self._step(*[column[order[a : a + MINIBATCH]] for column in piece[:4]])

    def _step(self, token, one, two, three) -> None:
        model = self.model
        leaf = model.leaves.of_symbol[token]
        of, place = model.leaves.class_of[leaf], model.leaves.place_of[leaf]
        found = model.features(one, two, three, of)
        errors = model.logits(found, of)
        for x, y in zip(errors, (of, place)):
            x -= x.max(axis=1, keepdims=True)
            np.exp(x, out=x)
            x /= x.sum(axis=1, keepdims=True)
            x[np.arange(len(y)), y] -= 1
        for k in (*OF_CLASS, *OF_LEAF, 7):
            rows = found[k] if k < 6 else of.astype(np.uint16)
            order = np.argsort(rows, kind="stable")
            ranked = rows[order]
            cuts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            sums = np.add.reduceat((errors[0] if k in OF_CLASS else errors[1])[order], cuts, axis=0)
            self._move(OFFSETS[k] + ranked[cuts].astype(np.int64), sums, np.diff(np.append(cuts, len(order))))
        self._move(OFFSETS[6:7], errors[0].sum(axis=0, keepdims=True), np.array([len(of)]))

    def _move(self, rows: np.ndarray, gradient: np.ndarray, times: np.ndarray) -> None:
        squares = self.squares[rows] + np.einsum("ij,ij->i", gradient, gradient)
        self.squares[rows] = squares
        self.model.weights[rows] -= gradient * (RATE / np.sqrt(squares))[:, None]
        self.touched[rows] += times

    def added(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By block of rows: which rows moved, how often each was seen, and its move times that number."""
        rows = np.flatnonzero(self.touched)
        moves = (self.model.weights[rows] - self.base.weights[rows]) * self.touched[rows, None].astype(np.float32)
        for block in np.unique(rows // BLOCK):
            own = rows // BLOCK == block
            yield int(block), rows[own] - block * BLOCK, self.touched[rows[own]], moves[own]


MOVES = "block long, shard long, rows binary, times binary, moves binary"


def _moves(block: int, shard: int, rows: np.ndarray, times: np.ndarray, moves: np.ndarray) -> pa.RecordBatch:
    binary = [rows.astype(np.int16).tobytes(), times.astype(np.int64).tobytes(), moves.astype(np.float32).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([shard]), *[pa.array([b], pa.binary()) for b in binary]], names=["block", "shard", "rows", "times", "moves"])


def round_moves(encoded: DataFrame, model: Model, shards: int, round_: int) -> DataFrame:
    """What each shard of a round adds to the weights."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def train(batches):
        shard, trainer, waiting, size = None, None, [], 0

        def finished():
            if trainer:
                trainer.learn(waiting)
                for part in trainer.added():
                    yield _moves(part[0], shard, *part[1:])

        for batch in batches:
            for number, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != shard:
                    yield from finished()
                    shard, trainer, waiting, size = number, Trainer(sent.value), [], 0
                waiting.append(symbols)
                size += len(symbols)
                if size >= 8 * PIECE:
                    trainer.learn(waiting)
                    waiting, size = [], 0
        yield from finished()

    own = encoded.where("NOT held_out").withColumn("shard", F.expr(f"pmod(xxhash64(row), {shards})")).where(f"pmod(shard, {ROUNDS}) = {round_}")
    dealt = own.select("shard", "symbols", "row").repartitionById(shards // ROUNDS, F.expr(f"CAST(shard div {ROUNDS} AS int)"))
    dealt = dealt.sortWithinPartitions("shard", "row")
    return dealt.select("shard", "symbols").mapInArrow(train, MOVES)


def added_up(moves: DataFrame, shards: int) -> DataFrame:
    """One row per block: moves of ``FAN_IN`` shards at a time are added in their order until none are left apart."""

    def add(batches):
        key, rows_seen, times, total = None, None, None, None

        def finished():
            if key is not None:
                rows = np.flatnonzero(rows_seen)
                yield _moves(key[0], key[1], rows, times[rows], total[rows])

        for batch in batches:
            block, shard, *packed = (batch.column(i).to_pylist() for i in range(5))
            for b, s, rows, n, move in zip(block, shard, *packed):
                if (b, s // FAN_IN) != key:
                    yield from finished()
                    key = (b, s // FAN_IN)
                    rows_seen, times, total = np.zeros(BLOCK, bool), np.zeros(BLOCK, np.int64), np.zeros((BLOCK, WAYS))
                at = np.frombuffer(rows, np.int16)
                rows_seen[at] = True
                times[at] += np.frombuffer(n, np.int64)
                total[at] += np.frombuffer(move, np.float32).reshape(-1, WAYS)
        yield from finished()

    group = F.expr(f"shard div {FAN_IN}")
    while True:
        moves = moves.repartition(max(1, math.ceil(shards / FAN_IN)) * 8, "block", group).sortWithinPartitions("block", "shard").mapInArrow(add, MOVES)
        shards = math.ceil(shards / FAN_IN)
        if shards <= 1:
            return moves


def fit(encoded: DataFrame, leaves: Leaves, training_tokens: int) -> Model:
    """``ROUNDS`` rounds; each training text is in one of them."""
    model = Model.new(leaves)
    shards = ROUNDS * max(1, math.ceil(training_tokens / (ROUNDS * SHARD_TOKENS)))
    for round_ in range(ROUNDS if training_tokens else 0):
        weights, seen = model.weights.copy(), model.seen.copy()
        for row in added_up(round_moves(encoded, model, shards, round_), shards).collect():  # at most N_ROWS rows of weights
            at = row["block"] * BLOCK + np.frombuffer(row["rows"], np.int16).astype(np.int64)
            times = np.frombuffer(row["times"], np.int64)
            weights[at] += np.frombuffer(row["moves"], np.float32).reshape(-1, WAYS) / times[:, None].astype(np.float32)
            seen[at] += times
        model = Model(leaves, weights, seen)
    return model


def model_scores(encoded: DataFrame, model: Model) -> DataFrame:
    """Per row: ``model``, the sum over its tokens of :meth:`Model.log10`."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            packed = batch.column(5).to_pylist()
            total = np.zeros(len(packed))
            for piece in pieces(packed):
                total += np.bincount(piece[4], sent.value.log10(piece), len(packed))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], batch.column(6), pa.array(total)], names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "model"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    columns = encoded.select("row", "doc_id", "held_out", "n_tokens", "known", "symbols", "logs")
    return columns.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, model double")


def score(docs: DataFrame, folds: int = 7, left_out: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigram
    with one added) and ``score``, both log10 probabilities of the whole text."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("held_out", remainder("doc_id", folds) == left_out)
    counts = settle(word_counts(rows), "word-counts")
    n, distinct, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("n")))).first()
    n, distinct = int(n or 0), int(distinct)
    words = Words.of(frequent_words(counts), int(ends or 0))
    encoded = settle(encode(rows.withColumn("row", F.monotonically_increasing_id()), words), "tokens")

    of_symbol = np.concatenate([words.leaves()[:CONTEXTS], np.zeros(max(0, CONTEXTS - len(words.words)), np.int64), np.arange(LEAVES)])
    sizes, pairs = leaf_sizes(counts, words), leaf_pairs(encoded, of_symbol)
    model = fit(encoded, Leaves(*sizes, *classes(pairs), of_symbol), n)

    # Words outside the table: the join needs no unseen ones, whose logarithm is 0.
    rest = encoded.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("often"))
    met = rest.join(counts, "word").groupBy("row").agg(F.sum("often").alias("more"), F.sum(F.col("often") * F.log10(F.col("n") + 1)).alias("more_logs"))
    found = model_scores(encoded, model).join(met, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(n + distinct + 1)).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
