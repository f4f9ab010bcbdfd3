"""Benchmark passages in documents: a prefix-filtered set join.

The sets are the shingles of item windows (``window`` consecutive words of an item; a shorter item is one window). A
document holds a window only if it holds all of its shingles, so, for full containment, the window's rarest shingle is a
necessary prefix of length one. Rarity is counted over all documents first. Documents are joined on these prefix
shingles alone; the place of the shingle in the window gives the only possible start (positional bound), which must
leave room for the whole window (length bound); then the words of that item-sized window are compared.

Scale. Both passes over the documents are maps. The windows are sent to the executors in blocks of at most
``BLOCK_BYTES`` of item text, so their size is bounded however many items there are: more items mean more passes. After
``BLOCKS_AT_ONCE`` blocks the result is written and their windows are let go. Items are dealt by id and text, so one id (or
none) may have any number of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.llm.common import WordHashes, over_batches, settle, slices, starts_of, texts, window_hashes

SHINGLE = 3
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
BLOCKS_AT_ONCE = 8
SIEVE_BITS = 20
# All ASCII but digits and letters separates words; upper case has become lower case before.
SEPARATORS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("from_word", T.IntegerType(), False), T.StructField("to_word", T.IntegerType(), False)]))


def words_of(content: bytes) -> list[bytes]:
    return content.lower().translate(SEPARATORS).split()


class Members:
    """A sorted set of hashes; a table of bits keeps most of the others away from the binary search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.hashes >> np.uint64(64 - SIEVE_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are in the set, and their numbers there."""
        at = np.flatnonzero(self.sieve[hashes >> np.uint64(64 - SIEVE_BITS)])
        number = np.searchsorted(self.hashes, hashes[at])
        number[number == len(self.hashes)] = 0
        found = self.hashes[number] == hashes[at] if len(self.hashes) else np.zeros(len(at), bool)
        return at[found], number[found]


@dataclass
class Windows:
    """Different item windows, the items that have each, and the hashes of their words (padded with zeros)."""

    words: list[tuple[bytes, ...]]
    items: list[list[str]]
    hashes: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, bytes]], width: int) -> Windows:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, content in rows:
            words = words_of(content)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                found.setdefault(tuple(words[i : i + width]), set()).add(item)
        memory = WordHashes()
        lengths = np.array([len(w) for w in found], np.int64)
        hashes = np.zeros((len(found), int(lengths.max(initial=1))), np.uint64)
        for i, w in enumerate(found):
            hashes[i, : len(w)] = memory.of(list(w))
        return Windows(list(found), [sorted(s) for s in found.values()], hashes, lengths)

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size: window, place in the window and hash of every shingle."""
        out = {}
        for size in range(1, SHINGLE + 1):
            own = np.flatnonzero(self.lengths == size if size < SHINGLE else self.lengths >= size)
            if len(own):
                counts = self.lengths[own] - size + 1
                window = np.repeat(own, counts)
                place = np.arange(len(window)) - np.repeat(starts_of(counts), counts)
                parts = np.stack([self.hashes[window, place + j] for j in range(size)], axis=1)
                out[size] = window, place, window_hashes(parts.ravel(), size)[::size]
        return out


def _documents(contents: list[bytes], memory: WordHashes):
    """Words of a slice of documents, their hashes, and where each document begins and ends."""
    split = [words_of(t) for t in contents]
    lengths = np.array([len(w) for w in split], np.int64)
    begins = starts_of(lengths)
    words = [w for own in split for w in own]
    return words, memory.of(words), begins, begins + lengths


def shingle_counts(docs: DataFrame, known: dict[int, Members], text: str) -> dict[tuple[int, int], int]:
    """How often the known shingles occur in all documents."""

    def run(batches):
        memory = WordHashes()
        counts = {size: np.zeros(len(m.hashes), np.int64) for size, m in known.items()}
        for batch in batches:
            contents = texts(batch.column(0))
            for a, b in slices(contents, SLICE_BYTES):
                _, hashes, _, _ = _documents(contents[a:b], memory)
                for size, members in known.items():
                    counts[size] += np.bincount(members.find(window_hashes(hashes, size))[1], minlength=len(members.hashes))
        for size, n in counts.items():
            own = np.flatnonzero(n)
            columns = [np.full(len(own), size), own, n[own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["size", "number", "n"])

    counted = docs.select(text).mapInArrow(run, "size long, number long, n long").groupBy("size", "number").agg(F.sum("n").alias("n"))
    return {(r["size"], r["number"]): r["n"] for r in counted.collect()}


class Prefixes:
    """For each window its rarest shingle and the place of that shingle."""

    def __init__(self, windows: Windows, known: dict[int, Members], counts: dict[tuple[int, int], int]):
        self.windows = windows
        self.by_size = {}
        for size, (window, place, hashes) in windows.shingles().items():
            members = known[size]
            number = np.searchsorted(members.hashes, hashes)
            n = np.array([counts.get((size, i), 0) for i in range(len(members.hashes))], np.int64)[number]
            order = np.lexsort((place, hashes, n, window))
            rarest = order[np.append(True, np.diff(window[order]) != 0)]
            rarest = rarest[np.argsort(hashes[rarest], kind="stable")]
            prefix = Members(hashes[rarest])
            ends = np.searchsorted(hashes[rarest], prefix.hashes, side="right")
            self.by_size[size] = prefix, window[rarest], place[rarest], np.append(0, ends)

    def hits(self, words: list[bytes], hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur: first word and window."""
        starts, found = [], []
        for size, (prefix, window, place, cuts) in self.by_size.items():
            at, number = prefix.find(window_hashes(hashes, size))
            n = cuts[number + 1] - cuts[number]
            entry = np.repeat(cuts[number], n) + np.arange(n.sum()) - np.repeat(starts_of(n), n)
            at = np.repeat(at, n)
            w = window[entry]
            document = np.searchsorted(begins, at, side="right") - 1
            start = at - place[entry]
            fits = (start >= begins[document]) & (start + self.windows.lengths[w] <= ends[document])
            start, w = start[fits], w[fits]
            for j in range(self.windows.hashes.shape[1]):
                inside = self.windows.lengths[w] > j
                same = ~inside
                same[inside] = hashes[start[inside] + j] == self.windows.hashes[w[inside], j]
                start, w = start[same], w[same]
            exact = [tuple(words[s : s + len(self.windows.words[i])]) == self.windows.words[i] for s, i in zip(start.tolist(), w.tolist())]
            exact = np.array(exact, bool)
            starts.append(start[exact]), found.append(w[exact])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *found])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_passages(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged word ranges, end exclusive) and ``hit_items`` (item ids as text).

    Every occurrence of every item window counts. Null, empty and word-free texts of documents and items have no words,
    hence no hits; an item without an id is called ``null``; repeated items count once.
    """
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    found, sent = docs, []
    for block in range(blocks):
        if len(sent) == BLOCKS_AT_ONCE:
            found = settle(found, "passages")
            while sent:
                sent.pop().destroy()
        rows = parts.where(F.pmod(F.xxhash64("item", "content"), F.lit(blocks)) == block).distinct().collect()
        windows = Windows.of(sorted((r["item"], bytes(r["content"])) for r in rows), window)
        known = {size: Members(hashes) for size, (_, _, hashes) in windows.shingles().items()}
        prefixes = Prefixes(windows, known, shingle_counts(docs, known, text) if known else {})
        sent.append(spark.sparkContext.broadcast(prefixes))
        found = _pass(found, sent[-1], text, first=block == 0)
    return found


def _pass(docs: DataFrame, shared, text: str, first: bool) -> DataFrame:
    at = docs.columns.index(text)
    before = None if first else [docs.columns.index(n) for n in ("hit_spans", "hit_items")]

    def compute(batch, memory=[]):  # noqa: B006  one table of words per Python worker
        memory = memory or [WordHashes()]
        prefixes = shared.value
        contents = texts(batch.column(at))
        n_words, all_spans, all_items = [], [], []
        for a, b in slices(contents, SLICE_BYTES):
            words, hashes, begins, ends = _documents(contents[a:b], memory[0])
            start, window = prefixes.hits(words, hashes, begins, ends)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            document = np.searchsorted(begins, start, side="right") - 1
            for d, s, w in zip(document.tolist(), start.tolist(), window.tolist()):
                s -= int(begins[d])
                spans.setdefault(d, []).append((s, s + int(prefixes.windows.lengths[w])))
                items.setdefault(d, set()).update(prefixes.windows.items[w])
            n_words += (ends - begins).tolist()
            all_spans += [spans.get(d, []) for d in range(b - a)]
            all_items += [items.get(d, set()) for d in range(b - a)]
        if before:
            earlier = [batch.column(i).to_pylist() for i in before]
            all_spans = [own + [(s["from_word"], s["to_word"]) for s in old] for own, old in zip(all_spans, earlier[0])]
            all_items = [own | set(old) for own, old in zip(all_items, earlier[1])]
        struct = pa.struct([pa.field("from_word", pa.int32(), False), pa.field("to_word", pa.int32(), False)])
        spans = [[{"from_word": x, "to_word": y} for x, y in merged(s)] for s in all_spans]
        return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(struct)), pa.array([sorted(i) for i in all_items], pa.list_(pa.string()))]

    added = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    return over_batches(docs, added, compute)
