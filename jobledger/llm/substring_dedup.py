"""Repeated passages: super-k-mer partitioning.

Each window of ``width`` words has a minimiser: the word in it that comes first in a fixed pseudo-random order (common
words come last, so that minimisers are spread). Consecutive windows with the same minimiser overlap in all but one
word, so they travel together, as one packed string, to the bucket of the minimiser. Equal windows have equal
minimisers, hence meet in one bucket, where sorting the windows finds every repetition. Window hashes only bring
candidates together; the words themselves are compared.

Scale. A super-k-mer holds about seven windows of 13 words in 19 words, so 2.7 words travel per word of text instead of 13.
A map task sends each bucket one compressed row per slice of text; super-k-mers name their document by its place in the
slice, and ids and hashes of the documents of a slice are sent once. Equal super-k-mers of a slice are sent once, for the
smallest id; the others are known to be repeated. A minimiser that a share of all super-k-mers has (a passage found in
very many documents) is split: its windows travel singly to the bucket of their own hash. Which minimisers to split is
decided on a sample; that changes routes only, never results. A bucket is what a task holds at a time: there is one for
each ``TEXT_PER_BUCKET`` of text, and at least ``BUCKETS_PER_PARTITION`` times as many as shuffle partitions. A minimiser is
split if it would fill ``FULL_BUCKETS`` buckets, so the more text there is, the rarer are the words that are split; at worst
all windows travel singly.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.llm.common import (
    WordHashes,
    attach,
    doc_key,
    over_batches,
    settle,
    slices,
    starts_of,
    text_tag,
    texts,
    window_hashes,
    window_minima,
)

SLICE_BYTES = 6 << 20
BUCKETS_PER_PARTITION = 8
TEXT_PER_BUCKET = 16 << 20
FULL_BUCKETS = 12
# The sample has at least so many rows, and one in so many.
SAMPLE_ROWS = 4000
ROWS_PER_SAMPLED = 250_000
COMMON_WORDS = 4096
LATE = 1 << 63
HEAD = struct.Struct("<bqqq")
TAG = np.dtype("V16")
# What a packed row holds (one place, one id each): super-k-mers (place, id, first word, words); spans that are known to be
# repeated (place, from, to); the documents of a slice (place, id, tag).
SUPER_KMERS, KNOWN, DOCUMENTS = 0, 1, 2
COLUMNS = {
    SUPER_KMERS: (np.dtype(np.int32), np.dtype(np.int64), np.dtype(np.int32), np.dtype(np.int32)),
    KNOWN: (np.dtype(np.int32), np.dtype(np.int32), np.dtype(np.int32)),
    DOCUMENTS: (np.dtype(np.int32), np.dtype(np.int64), TAG),
}


class WordOrder(WordHashes):
    """Place of a word among minimisers: common words after all others."""

    def __init__(self, common: frozenset[bytes]):
        super().__init__()
        self.common = common

    def value(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word) >> 1 | (LATE if word in self.common else 0)


def super_kmers(order: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: text, first window, last window (as word positions in all texts), minimiser.

    Every text has at least ``width`` words.
    """
    minima = window_minima(order, width)
    begins = starts_of(lengths)
    n_windows = lengths - width + 1
    valid = np.repeat(begins - starts_of(n_windows), n_windows) + np.arange(n_windows.sum())
    minima = minima[valid]
    new = np.ones(len(valid), bool)
    new[1:] = minima[1:] != minima[:-1]
    new[starts_of(n_windows)] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return np.repeat(np.arange(len(lengths)), n_windows)[first], valid[first], valid[last], minima[first]


def pack(kind: int, slice_: int, *columns: np.ndarray, text: bytes = b"", squeeze: zstandard.ZstdCompressor) -> bytes:
    values = [np.ascontiguousarray(c, dtype).tobytes() for c, dtype in zip(columns, COLUMNS[kind])]
    return squeeze.compress(HEAD.pack(kind, slice_, len(columns[0]), len(text)) + b"".join(values) + text)


def unpack(blob: bytes) -> tuple[int, int, list[np.ndarray], bytes]:
    """Kind, slice, columns and text."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    kind, slice_, n, size = HEAD.unpack_from(raw)
    at, columns = HEAD.size, []
    for dtype in COLUMNS[kind]:
        columns.append(np.frombuffer(raw, dtype, n, at))
        at += n * dtype.itemsize
    return kind, slice_, columns, raw[at : at + size]


def _route(docs: DataFrame, width: int, common: frozenset[bytes], heavy: np.ndarray, buckets: int) -> DataFrame:
    """One row per slice of texts and bucket."""

    def run(batches):
        order_of, squeeze = WordOrder(common), zstandard.ZstdCompressor(level=6)
        for batch in batches:
            contents = texts(batch.column(2))
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            tags = np.frombuffer(b"".join(batch.column(1).to_pylist()), TAG)
            for a, b in slices(contents, SLICE_BYTES):
                rows = _route_slice(contents[a:b], ids[a:b], tags[a:b], width, order_of, heavy, buckets, squeeze)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "packed"])

    return docs.mapInArrow(run, "bucket int, packed binary")


def _route_slice(contents, ids, tags, width, order_of, heavy, buckets, squeeze) -> list[tuple[int, bytes]]:
    split = [t.split() for t in contents]
    long_enough = [i for i, w in enumerate(split) if len(w) >= width]
    if not long_enough:
        return []
    lengths = np.array([len(split[i]) for i in long_enough], np.int64)
    words = [w for i in long_enough for w in split[i]]
    del split
    order = order_of.of(words)
    text, first, last, minimiser = super_kmers(order, lengths, width)
    key = minimiser
    single = np.isin(minimiser, heavy)
    if single.any():
        # The windows of split minimisers, one by one, by their own hash.
        n = (last - first + 1)[single]
        at = np.repeat(first[single] - starts_of(n), n) + np.arange(n.sum())
        own = window_hashes(order, width)[at]
        text, first, last, key = (
            np.concatenate((x[~single], y)) for x, y in ((text, np.repeat(text[single], n)), (first, at), (last, at), (key, own))
        )
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate(([0], ends[:-1]))
    strings = [joined[a:b] for a, b in zip(begin[first].tolist(), (ends[last + width - 1] - 1).tolist())]
    of = np.array(long_enough)[text]
    own_id = ids[of]
    # Slices with equal documents may have equal numbers: then their documents have equal places.
    slice_ = xxhash.xxh64_intdigest(ids.tobytes() + tags.tobytes()) >> 1
    position = (first - starts_of(lengths)[text]).astype(np.int32)
    n_words = (last - first + width).astype(np.int32)
    # Equal strings of this slice are sent for the smallest id only.
    number: dict[bytes, int] = {}
    same = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, same, own_id)
    known = own_id > least[same]
    held = np.array(long_enough)
    out = [(slice_ % buckets, pack(DOCUMENTS, slice_, held, ids[held], tags[held], squeeze=squeeze))]
    if known.any():
        out.append((slice_ % buckets, pack(KNOWN, slice_, of[known], position[known], (position + n_words)[known], squeeze=squeeze)))
    sent = np.flatnonzero(~known)
    bucket = (key[sent] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
    ranked = np.argsort(bucket, kind="stable")
    sent, bucket = sent[ranked], bucket[ranked]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sent)]):
        rows = sent[a:b]
        text_of = b"\n".join([strings[i] for i in rows.tolist()])
        out.append((int(bucket[a]), pack(SUPER_KMERS, slice_, of[rows], own_id[rows], position[rows], n_words[rows], text=text_of, squeeze=squeeze)))
    return out


class WordNumbers(dict):
    """Numbers of words in order of appearance: equal words, equal numbers."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def repeated_windows(owner: np.ndarray, numbers: np.ndarray, hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which windows (``starts``) have a word sequence that some smaller owner has too."""
    value = window_hashes(hashes, width)[starts]
    ranked = np.argsort(value)
    ordered = value[ranked]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)
    cuts = np.flatnonzero(new)
    sizes = np.diff(np.append(cuts, len(ordered)))
    group = np.repeat(np.arange(len(cuts)), sizes)
    least = np.minimum.reduceat(owner[ranked], cuts) if len(cuts) else np.zeros(0, np.int64)
    out = np.zeros(len(starts), bool)
    out[ranked] = owner[ranked] > least[group] if len(cuts) else False
    # Equal hashes are candidates: compare the words with those of the first window of the group.
    shared = np.flatnonzero(sizes[group] > 1) if len(cuts) else np.zeros(0, np.int64)
    if len(shared):
        at, model = starts[ranked[shared]], starts[ranked[cuts[group[shared]]]]
        differs = np.zeros(len(shared), bool)
        for j in range(width):
            differs |= numbers[at + j] != numbers[model + j]
        for g in np.unique(group[shared[differs]]).tolist():
            members = ranked[cuts[g] : cuts[g] + sizes[g]]
            first: dict[bytes, int] = {}
            for m in members.tolist():
                words = numbers[starts[m] : starts[m] + width].tobytes()
                first[words] = min(first.get(words, owner[m]), owner[m])
            for m in members.tolist():
                out[m] = owner[m] > first[numbers[starts[m] : starts[m] + width].tobytes()]
    return out


def _bucket_spans(parts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What a bucket tells of documents, each by slice and place: spans of repeated windows (from, to; word positions), or
    the document itself (id and tag)."""
    sent = []
    for kind, slice_, columns, text in map(unpack, parts):
        if kind == SUPER_KMERS:
            sent.append((np.full(len(columns[0]), slice_), columns, text))
        else:
            yield kind, np.full(len(columns[0]), slice_), *columns
    if sent:
        slices_ = np.concatenate([s for s, _, _ in sent])
        places, ids, position, n_words = (np.concatenate([c[i] for _, c, _ in sent]) for i in range(4))
        number = WordNumbers()
        numbers = np.concatenate([np.fromiter(map(number.__getitem__, t.split()), np.int32) for _, _, t in sent])
        words = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        n_windows = n_words.astype(np.int64) - width + 1
        row = np.repeat(np.arange(len(ids)), n_windows)
        offset = np.arange(len(row)) - np.repeat(starts_of(n_windows), n_windows)
        starts = starts_of(n_words.astype(np.int64))[row] + offset
        hit = np.flatnonzero(repeated_windows(ids[row], numbers, words[numbers], starts, width))
        if len(hit):
            # Neighbouring windows of a super-k-mer make one span.
            new = np.append(True, (np.diff(hit) != 1) | (np.diff(row[hit]) != 0))
            a = hit[new]
            b = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
            yield KNOWN, slices_[row[a]], places[row[a]], position[row[a]] + offset[a], position[row[b]] + offset[b] + width


NOTES = "slice long, place int, key long, tag binary, from_word int, to_word int"


def _notes(kind: int, slices_: np.ndarray, places: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(places), t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.int32())]
    if kind == DOCUMENTS:
        none[:2] = [pa.array(columns[0]), pa.array(columns[1].tolist(), pa.binary())]
    else:
        none[2:] = [pa.array(c.astype(np.int32)) for c in columns]
    names = [part.split()[0] for part in NOTES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(slices_), pa.array(places.astype(np.int32)), *none], names=names)


def repeated_spans(docs: DataFrame, width: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with repetitions: ``key``, ``tag`` and ``spans`` of words that repeat a document with a smaller id.

    A span is a run of windows, as word positions, end exclusive; spans may overlap. Documents of fewer than ``width``
    words, empty and null texts have none. Rows with equal ids are one document and do not repeat each other.
    """
    spark = docs.sparkSession
    rows = docs.select(doc_key(doc_id).alias("key"), text_tag(text).alias("tag"), F.col(text).alias("text"))
    sample, size = _sample(rows)
    buckets = max(BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), size // TEXT_PER_BUCKET)
    common, heavy = _routes(sample, width, max(1000, buckets // FULL_BUCKETS))
    routed = _route(rows, width, common, heavy, buckets).repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        current, parts = None, []

        def notes():
            for found in _bucket_spans(parts, width):
                yield _notes(*found)

        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != current:
                    yield from notes()
                    current, parts = bucket, []
                parts.append(packed)
        yield from notes()

    span = F.when(F.col("from_word").isNotNull(), F.struct("from_word", "to_word"))
    told = routed.mapInArrow(run, NOTES).groupBy("slice", "place").agg(F.first("key", True).alias("key"), F.first("tag", True).alias("tag"), F.collect_list(span).alias("spans"))
    return told.where(F.size("spans") > 0).groupBy("key", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _sample(rows: DataFrame) -> tuple[DataFrame, int]:
    """Some rows, and how many bytes of text all rows have if they are like these."""
    n = rows.count()
    sample = settle(rows.sample(min(1.0, max(SAMPLE_ROWS, n // ROWS_PER_SAMPLED) / max(n, 1)), seed=7), "passage-sample")
    taken, size = sample.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return sample, (size or 0) * n // max(taken, 1)


def _routes(sample: DataFrame, width: int, parts: int) -> tuple[frozenset[bytes], np.ndarray]:
    """Common words, and the minimisers that have more than one of so many parts of all super-k-mers, from a sample."""
    word = sample.select(F.explode(F.split(F.col("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    top = word.groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(COMMON_WORDS).collect()
    common = frozenset(r["word"].encode() for r in top)

    def run(batches):
        order_of = WordOrder(common)
        for batch in batches:
            for t in texts(batch.column(2)):
                words = t.split()
                if len(words) >= width:
                    found = super_kmers(order_of.of(words), np.array([len(words)]), width)[3]
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["minimiser"])

    counts = sample.mapInArrow(run, "minimiser long").groupBy("minimiser").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    # At most ``parts`` minimisers can have such a part each.
    frequent = counts.where(F.col("count") > F.lit(max(8.0, total / parts))).select("minimiser").collect()
    return common, np.array([r[0] for r in frequent], np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, width: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (the words that stay, joined by one space).

    A word goes if any window of ``width`` words that covers it also starts in a document with a smaller id, judged on
    the input as it came. Null and empty texts: 0 words, empty ``kept_text``.
    """
    spans = repeated_spans(docs, width, doc_id, text)
    keyed = docs.withColumns({"__key": doc_key(doc_id), "__tag": text_tag(text)})
    noted = attach(keyed, spans.withColumnsRenamed({"key": "__key", "tag": "__tag", "spans": "__spans"}), ["__key", "__tag"])
    at, marks = noted.columns.index(text), noted.columns.index("__spans")

    def compute(batch):
        n_words, n_removed, kept = [], [], []
        for content, spans in zip(texts(batch.column(at)), batch.column(marks).to_pylist()):
            words = content.split()
            n_words.append(len(words))
            if spans:
                stays = np.ones(len(words), bool)
                for s in spans:
                    stays[s["from_word"] : s["to_word"]] = False
                words = [words[i] for i in np.flatnonzero(stays).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return over_batches(noted, added, compute).drop("__key", "__tag", "__spans")
