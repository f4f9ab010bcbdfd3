"""Compression of vectors to short codes (product quantisation) with dictionaries of the values of each dimension.

Components become integers, ``floor(scale * x)``. Rows are kept in blocks that store, for every dimension, the sorted
distinct integers of the block and each row's place among them. Against a codebook the squared differences of every distinct
integer to all entries are tabulated once per block; the distance of a part is then a gather per dimension and an add, and
all arithmetic is exact. Dictionaries belong to blocks (at most ``BLOCK_ROWS`` values), so nothing grows with the range of
values or with the table.

Codebooks are fitted by rounds of assignment and replacement over all rows. A task adds up counts and sums of its blocks
(``parts * entries`` rows), Spark adds those up, and the driver sees the sums of the entries only.

Defined results
    * Rows whose vector is null or has a null or non-finite component are left out. An empty table gives no rows and empty
      codebooks; with fewer rows than entries there are as many entries as rows.
    * A null id is the largest. Rows with equal ids are ordered by their vectors; rows that repeat get the same code.
    * Vectors must have one length that ``parts`` divides and integers below 2^26 in size (16 384 for a scale of 4 096),
      which keeps every sum of squares within 64 bits; anything else is a ``ValueError``.
    * Other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobledger.llm.common import doc_key, settle

BLOCK_ROWS = 8192
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def floors(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


@dataclass(frozen=True)
class Block:
    """Some rows: the distinct integers of each dimension, and the place of each row's component among them."""

    dictionaries: list[np.ndarray]
    places: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Block:
        found = [np.unique(column, return_inverse=True) for column in values.T]
        return cls([f[0] for f in found], np.array([f[1] for f in found], np.uint16).reshape(len(found), len(values)))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        sizes = np.array([len(d) for d in self.dictionaries], np.int32)
        return sizes.tobytes(), np.concatenate([*self.dictionaries, np.zeros(0, np.int64)]).astype(np.int64).tobytes(), self.places.tobytes()

    @classmethod
    def unpacked(cls, sizes: bytes, values: bytes, places: bytes) -> Block:
        cuts = np.cumsum(np.frombuffer(sizes, np.int32))
        return cls(np.split(np.frombuffer(values, np.int64), cuts)[:-1], np.frombuffer(places, np.uint16).reshape(len(cuts), -1))

    def nearest(self, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, both (parts x rows); ties go to the lower index."""
        parts, entries, width = codebooks.shape
        index = np.empty((parts, self.places.shape[1]), np.uint8)
        error = np.empty(index.shape, np.int64)
        for p in range(parts):
            distance = np.zeros((self.places.shape[1], entries), np.int64)
            for j in range(width):
                d = p * width + j
                squares = (self.dictionaries[d][:, None] - codebooks[p, :, j][None, :]) ** 2
                distance += squares[self.places[d]]
            index[p] = distance.argmin(axis=1)
            error[p] = distance.min(axis=1)
        return index, error

    def sums(self, index: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """How many parts chose each entry (parts x entries) and the sums of their components (parts x entries x width)."""
        parts = len(index)
        width = len(self.dictionaries) // parts
        counts = np.array([np.bincount(i, minlength=entries) for i in index])
        sums = np.empty((parts, entries, width), np.int64)
        for p in range(parts):
            for j in range(width):
                own = self.dictionaries[p * width + j]
                # How often each entry met each distinct integer.
                met = np.bincount(index[p].astype(np.int64) * len(own) + self.places[p * width + j], minlength=entries * len(own))
                sums[p, :, j] = met.reshape(entries, len(own)) @ own
        return counts, sums


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(lengths) != 1 or not lengths[0] or lengths[0] % parts:
        raise ValueError(f"vectors must have one length that {parts} divides, found {lengths.tolist()}")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
    if np.abs(values).max() >= LARGEST:
        raise ValueError(f"components must be below {LARGEST} after scaling")
    return values


def blocks(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (``vec_id``, ``label``, ``x``) as blocks: packed dictionaries and places, with the ids and labels of their rows."""

    def pack(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                sizes, values, places = Block.of(_matrix(part.column(2), parts)).packed()
                ids, labels = ([part.column(i).to_pylist()] for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.list_(pa.int64())), pa.array(labels, pa.list_(part.column(1).type)), *(pa.array([b], pa.binary()) for b in (sizes, values, places))],
                    names=["vec_id", "label", "sizes", "distinct", "places"],
                )

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "x").mapInArrow(pack, f"vec_id array<long>, label array<{label}>, sizes binary, distinct binary, places binary")


def _opened(batch: pa.RecordBatch) -> list[Block]:
    return [Block.unpacked(*packed) for packed in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("sizes", "distinct", "places")))]


def replaced(packed: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the floored mean of the parts nearest to it; unused entries stay."""
    parts, entries, width = codebooks.shape

    def add(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for block in _opened(batch):
                more, added = block.sums(block.nearest(codebooks)[0], entries)
                counts, sums = counts + more, sums + added
        p, e = np.nonzero(counts)
        columns = [pa.array(c) for c in (p, e, counts[p, e], *sums[p, e].T)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *[f"s{j}" for j in range(width)]])

    names = ["n", *[f"s{j}" for j in range(width)]]
    found = packed.select("sizes", "distinct", "places").mapInArrow(add, "part long, entry long, " + ", ".join(f"{n} long" for n in names))
    total = found.groupBy("part", "entry").agg(*[F.sum(F.col(n).cast("decimal(38, 0)")).alias(n) for n in names])
    new = codebooks.copy()
    for row in total.collect():  # at most parts x entries rows
        new[row["part"], row["entry"]] = [int(row[f"s{j}"]) // int(row["n"]) for j in range(width)]
    return new


@dataclass(frozen=True)
class Codes:
    """``rows``: ``vec_id``, ``label``, ``codes`` (a byte per part) and ``error``; the codebooks are (parts x entries x width)."""

    rows: DataFrame
    codebooks: np.ndarray


def compress(
    table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> Codes:
    """Fits codebooks on all rows, starting from the vectors with the smallest ids, and encodes all rows."""
    if not 1 <= entries <= 256:
        raise ValueError("an index is one byte")
    x = F.col(f"`{vector}`")
    rows = table.where(finite(x)).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), floors(x, scale).alias("x"))
    first = rows.select(doc_key("vec_id").alias("key"), "x").orderBy("key", "x").limit(entries).collect()
    packed = settle(blocks(rows, parts), "vector-blocks")
    codebooks = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2) if first else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if first else 0):
        codebooks = replaced(packed, codebooks)

    def encode(batches):
        for batch in batches:
            for i, block in enumerate(_opened(batch)):
                index, error = block.nearest(codebooks)
                codes = [row.tobytes() for row in np.ascontiguousarray(index.T)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, pa.array(codes, pa.binary()), pa.array(error.sum(axis=0))],
                    names=["vec_id", "label", "codes", "error"],
                )

    kind = rows.schema["label"].dataType.simpleString()
    return Codes(packed.mapInArrow(encode, f"vec_id long, label {kind}, codes binary, error long"), codebooks)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``: the errors of all rows with the same label together; null is a label like any other."""
    rows = settle(rows, "vector-codes")
    total = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38, 0)")).cast("long").alias("label_error"))
    total = total.withColumnRenamed("label", "of")
    return rows.join(total, rows["label"].eqNullSafe(total["of"]), "left").drop("of")
