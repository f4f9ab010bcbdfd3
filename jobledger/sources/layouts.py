"""Columns that change over the years: the layouts of a stored table, and how they are read as one.

A scheduler upgrade adds, drops or reorders columns, and databases written by other tools hold narrower numbers. Every write
registers the columns and types of its rows below ``_layouts`` in the table (one small document per different layout, not
per write). Reading unites them by name: a column that a file does not have is null there, and a narrower type is widened
while the file is read. Types that no common type holds are refused when they are written, before any row is.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from jobledger.sources.publish import Folders

LAYOUTS = "_layouts"
# Each type with those that hold all its values and that a Parquet file of it can be read as.
WIDER = {
    T.ByteType(): (T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()),
    T.ShortType(): (T.IntegerType(), T.LongType(), T.DoubleType()),
    T.IntegerType(): (T.LongType(), T.DoubleType()),
    T.FloatType(): (T.DoubleType(),),
    T.DateType(): (T.TimestampNTZType(),),
}


class LayoutConflict(TypeError):
    """A column has types that cannot be read as one."""


def widened(name: str, one: T.DataType, other: T.DataType) -> T.DataType:
    if one == other or other in WIDER.get(one, ()):
        return other
    if one in WIDER.get(other, ()):
        return one
    raise LayoutConflict(f"column {name} holds {one.simpleString()} in some layouts and {other.simpleString()} in others")


def united(layouts: Iterable[T.StructType]) -> T.StructType:
    """All columns in the order in which they first came, each with the narrowest type that holds all of its types."""
    found: dict[str, T.DataType] = {}
    for layout in layouts:
        for field in layout:
            found[field.name] = widened(field.name, found.get(field.name, field.dataType), field.dataType)
    return T.StructType([T.StructField(name, kind) for name, kind in found.items()])


def known(spark: SparkSession, root: str) -> list[T.StructType]:
    """The registered layouts, the oldest first."""
    folder = f"{root.rstrip('/')}/{LAYOUTS}"
    names = sorted(n for n in Folders(spark, root).names(folder) if not n.startswith("."))
    if not names:
        return []
    found = spark.read.text([f"{folder}/{n}" for n in names]).selectExpr("_metadata.file_path AS file", "value").collect()
    return [T.StructType.fromJson(json.loads(r["value"])) for r in sorted(found, key=lambda r: r["file"])]


def register(spark: SparkSession, root: str, schema: T.StructType, partitions: Iterable[str] = ()) -> None:
    """Remembers the columns of rows about to be written; columns that are ``partitions`` are not in files."""
    layout = T.StructType([T.StructField(f.name, f.dataType) for f in schema if f.name not in partitions])
    before = known(spark, root)
    united([*before, layout])
    if layout not in before:
        document = spark.createDataFrame([(layout.json(),)], "value string").coalesce(1)
        document.write.mode("ignore").text(f"{root.rstrip('/')}/{LAYOUTS}/layout-{len(before):06d}-{zlib.crc32(layout.json().encode()):08x}")


def stored_schema(spark: SparkSession, root: str) -> T.StructType | None:
    """What the table's files are to be read with; None for a table that nobody registered layouts of."""
    layouts = known(spark, root)
    return united(layouts) if layouts else None
