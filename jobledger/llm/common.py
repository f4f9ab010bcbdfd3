"""What the operators of this folder share: identity of rows, word hashes, intermediate tables, passes over Arrow batches.

Conventions of all operators
    * A null text has no words and no bytes. A null ``doc_id`` counts as the largest id (``LAST_ID``).
    * Rows that repeat (or share a ``doc_id``) stay separate rows of the result, and get the same verdict if their texts
      are equal. Columns an operator does not know are passed through or ignored; where a result column has the name of
      an input column, the result replaces it. Names that begin with two underscores are reserved.
    * An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.session import scratch_path

LAST_ID = (1 << 63) - 1
# The six ASCII separators between words, as code points 0x20 and 0x09 to 0x0D; bytes.split() splits at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes an intermediate table to the folder all executors share and reads it back, which cuts the lineage.

    The files go when the session ends: a result that is not computed yet may still need them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(name: str = "doc_id") -> Column:
    """The id as a number that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def text_tag(name: str = "text") -> Column:
    """128 bits of the text; tells rows that share a ``doc_id`` apart."""
    return F.unhex(F.md5(F.coalesce(F.col(name), F.lit(""))))


def attach(docs: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Left-joins a table with at most one row per key.

    No hint: texts and notes meet by a sort-merge join, whose large partitions adaptive execution splits, unless Spark
    measures the notes to be under its own threshold for sending them to all executors.
    """
    return docs.join(notes, keys, "left")


def over_batches(docs: DataFrame, added: list[T.StructField], compute: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``docs`` with further columns that ``compute`` makes from each Arrow batch, in a pass without shuffle."""
    names = {f.name for f in added}
    kept = docs.select(*[F.col(f"`{f.name}`") for f in docs.schema if f.name not in names])
    schema = T.StructType([*kept.schema.fields, *added])
    positions = [i for i, f in enumerate(docs.schema) if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = compute(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in positions], *new], names=schema.names)

    return docs.mapInArrow(run, schema)


# Packed values of so many tasks are merged by one task of the next level.
FAN_IN = 16


def merge_packed(parts: DataFrame, merge: Callable[[Iterator[bytes]], bytes]) -> bytes | None:
    """One value from a table of packed values (column ``packed``), ``FAN_IN`` tasks' values at a time; None if there is none.

    Each level is written, so that a lost executor costs one level, and one value is all the driver sees.
    """

    def one(batches):
        merged = merge(p for batch in batches for p in batch.column(0).to_pylist())
        if merged:
            yield pa.RecordBatch.from_arrays([pa.array([merged], pa.binary())], names=["packed"])

    while (count := (parts := settle(parts, "partial")).count()) > 1:
        parts = parts.repartition(max(1, count // FAN_IN)).mapInArrow(one, "packed binary")
    row = parts.first()
    return bytes(row["packed"]) if row else None


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def slices(contents: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each, at least one row."""
    start = total = 0
    for i, text in enumerate(contents):
        total += len(text)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(contents):
        yield start, len(contents)


class WordHashes(dict):
    """XXH64 of words, remembered; forgotten as a whole when there are too many."""

    def __init__(self, seed: int = 0, most: int = 150_000):
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.value(word)
        return found

    def value(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word, self.seed)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


# Odd multiplier of a polynomial hash modulo 2^64.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive entries, order counts; one shorter than the input by ``width - 1``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= MULTIPLIER
        out += hashes[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, by doubling."""
    n, reach, out = len(values), 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    if reach < width:
        out = np.minimum(out[: n - width + 1], out[width - reach : n - reach + 1])
    return out


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each group begins if the groups follow each other."""
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
