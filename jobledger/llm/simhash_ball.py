"""Near-duplicate documents by SimHash: meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2r bits have a common variant that differs in at most r bits from each.
So every distinct fingerprint emits all variants within r bits (2081 for r = 2); fingerprints that share a variant meet.
All that share one variant are within 2r bits of each other, so linking them to one of them loses no connection and emits
no pairs within the group.

Scale. Documents with equal fingerprints are one node. Variants go to buckets by a linear code over GF(2): the bucket of a
variant is the code of the fingerprint xor the code of the flipped bits. Hence a bucket needs each fingerprint once, in
8 bytes, however many of its variants belong there, and makes just those variants itself. The number of buckets follows
the number of fingerprints, so that a bucket always holds about ``VARIANTS_PER_BUCKET`` variants; with more than 2081
buckets a fingerprint goes to those that get a variant of it. Each bucket reports a spanning forest, at most one edge for
each fingerprint in it.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.llm.common import attach, doc_key, over_batches, settle, slices, starts_of, text_tag, texts
from jobledger.llm.components import star_edges

SEED = 42
SLICE_BYTES = 4 << 20
VARIANTS_PER_BUCKET = 1 << 22
FINGERPRINTS_AT_ONCE = 2000
LANES = np.uint64(0x0001000100010001)
MOST_IN_LANE = (1 << 16) - 1


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per group of hashes: bit set if more than half of the group have it; empty groups give 0."""
    out = np.zeros(len(counts), np.uint64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    # 16-bit counters, four to a word; groups are cut so that no counter overflows.
    sizes = counts[own]
    cuts = -(-sizes // MOST_IN_LANE)
    of = np.repeat(np.arange(len(own)), cuts)
    piece = np.arange(len(of)) - np.repeat(starts_of(cuts), cuts)
    begin = starts_of(sizes)[of] + piece * MOST_IN_LANE
    ones = np.empty((len(own), 64), np.int64)
    first = starts_of(cuts)
    for shift in range(16):
        sums = np.add.reduceat(hashes >> np.uint64(shift) & LANES, begin)
        for lane in range(4):
            ones[:, shift + 16 * lane] = np.add.reduceat((sums >> np.uint64(16 * lane) & np.uint64(MOST_IN_LANE)).astype(np.int64), first)
    out[own] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def text_fingerprints(contents: list[bytes], shingle: int) -> np.ndarray:
    split = [t.lower().split() for t in contents]
    lengths = np.array([len(w) for w in split], np.int64)
    joined = b" ".join([w for words in split for w in words])
    ends = np.cumsum(np.fromiter((len(w) for words in split for w in words), np.int64, int(lengths.sum())) + 1)
    begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    counts = np.where(lengths >= shingle, lengths - shingle + 1, np.minimum(lengths, 1))
    row = np.repeat(np.arange(len(split)), counts)
    first = starts_of(lengths)[row] + np.arange(len(row)) - np.repeat(starts_of(counts), counts)
    last = first + np.minimum(lengths, shingle)[row] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(begin[first].tolist(), (ends[last] - 1).tolist())), np.uint64, len(row)
    )
    return majority_bits(hashes, counts)


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint long``: the bits that more than half of the shingles' XXH64 have.

    Shingles are ``shingle`` words with A-Z lower-cased, repeats included; fewer words make one shingle. No words (null,
    empty or blank text): 0.
    """
    at = docs.columns.index(text)

    def compute(batch):
        contents = texts(batch.column(at))
        found = [text_fingerprints(contents[a:b], shingle) for a, b in slices(contents, SLICE_BYTES)]
        return [pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())]

    return over_batches(docs, [T.StructField("fingerprint", T.LongType())], compute)


class BallCode:
    """Variants within ``radius`` bits and the linear code that deals them to ``2 ** bits`` buckets."""

    def __init__(self, radius: int, bits: int):
        self.distance = 2 * radius
        self.columns = np.random.default_rng(20).integers(0, 1 << bits, 64, np.int64)
        flips = [f for k in range(radius + 1) for f in combinations(range(64), k)]
        masks = np.array([sum(1 << j for j in f) for f in flips], np.uint64)
        codes = self.of(masks)
        ranked = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(codes[ranked]) != 0))
        self.used = codes[ranked][cuts]
        self.masks = dict(zip(self.used.tolist(), np.split(masks[ranked], cuts[1:])))

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for j in range(64):
            out ^= (values >> np.uint64(j) & np.uint64(1)).astype(np.int64) * self.columns[j]
        return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 and edges a-b: the smallest node that each can reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def bucket_links(values: np.ndarray, bucket: int, code: BallCode) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a variant in this bucket, as a spanning forest."""
    none = np.zeros(0, np.uint64)
    if len(values) < 2:
        return none, none
    values = np.sort(values)
    codes = code.of(values)
    ranked = np.argsort(codes, kind="stable")
    variants, owners = [], []
    for part in np.split(ranked, np.flatnonzero(np.diff(codes[ranked])) + 1):
        masks = code.masks.get(int(codes[part[0]]) ^ bucket)
        if masks is not None:
            variants.append((values[part][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(part.astype(np.int32), len(masks)))
    if not variants:
        return none, none
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    variants, owners = variants[order], owners[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    if not len(same):
        return none, none
    a, b = owners[same], owners[same + 1]
    near = np.bitwise_count(values[a] ^ values[b]) <= code.distance
    label = forest(len(values), a[near], b[near])
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def ball_links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints that connect all that are linked by steps of ``distance`` bits or fewer.

    ``distance`` is even: then all that share a variant are within it.
    """
    if distance % 2:
        raise ValueError("the distance must be even")
    n, radius = prints.count(), distance // 2
    ball = sum(math.comb(64, k) for k in range(radius + 1))
    code = BallCode(radius, max(0, math.ceil(math.log2(max(1, n * ball / VARIANTS_PER_BUCKET)))))

    def emit(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(every), FINGERPRINTS_AT_ONCE):
                values = every[at : at + FINGERPRINTS_AT_ONCE]
                buckets = (code.of(values)[:, None] ^ code.used[None, :]).ravel()
                order = np.argsort(buckets, kind="stable")
                buckets, sent = buckets[order], np.repeat(values, len(code.used))[order]
                cuts = np.flatnonzero(np.append(True, np.diff(buckets) != 0))
                packed = [p.tobytes() for p in np.split(sent, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(buckets[cuts], pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    def meet(batches):
        current, parts = None, []

        def links():
            if parts:
                u, v = bucket_links(np.frombuffer(b"".join(parts), np.uint64), current, code)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != current:
                    yield from links()
                    current, parts = bucket, []
                parts.append(packed)
        yield from links()

    dealt = prints.select("fingerprint").mapInArrow(emit, "bucket long, packed binary").repartition("bucket")
    links = dealt.sortWithinPartitions("bucket").mapInArrow(meet, "u long, v long")
    return links.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``key``, ``tag``, ``fingerprint``, ``root`` of its group and ``component``.

    ``component`` is the smallest key that the row is linked to, itself included.

    Rows with equal ids, null ids and texts without words follow the conventions of the folder; texts without words all
    have fingerprint 0 and are linked like any other.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), doc_key(doc_id).alias("key"), text_tag(text).alias("tag"), F.col(text).alias("text"))
    rows = settle(fingerprints(rows, shingle).drop("text"), "fingerprints")
    prints = settle(rows.groupBy("fingerprint").agg(F.min("key").alias("least")), "distinct-fingerprints")
    stars = star_edges(ball_links(prints, distance))
    rooted = prints.join(stars.withColumnsRenamed({"u": "fingerprint", "v": "root"}), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = rooted.join(least, "root").select("fingerprint", "root", "component")
    return rows.join(labels, "fingerprint").select("doc_id", "key", "tag", "fingerprint", "root", "component")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group: the smallest id; of rows that repeat as a whole, one."""
    found = settle(near_duplicates(docs, shingle, distance, doc_id, text), "groups")
    first = found.groupBy("root").agg(F.min(F.struct("key", "tag")).alias("first")).select("first.key", "first.tag")
    first = first.withColumnsRenamed({"key": "__key", "tag": "__tag"}).withColumn("__stays", F.lit(True))
    keyed = docs.withColumns({"__key": doc_key(doc_id), "__tag": text_tag(text)})
    kept = attach(keyed, first, ["__key", "__tag"]).where("__stays")
    if not found.groupBy("key", "tag").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__key", "__tag"])
    return kept.select(*[f"`{c}`" for c in docs.columns])
