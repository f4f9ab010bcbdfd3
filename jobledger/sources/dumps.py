"""Delimited accounting dumps and input-size tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobledger.operators.lines import is_whole, typed_fields
from jobledger.schema import ACCOUNTING_SCHEMA, INPUT_SIZE_SCHEMA, SEPARATOR
from jobledger.sources.store import FAITHFUL


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw lines of one or more dumps; files are split, so size does not matter."""
    return spark.read.text(paths)


def header_lines(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The first line of each file, all in one job."""
    if len(files) == 1:
        first = spark.read.text(files[0]).first()
        return {files[0]: first["value"]} if first else {}
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")
    )
    found = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "n").alias("value")).collect()
    by_name = {re.sub(LOCAL, "file:/", r["file"]): r["value"] for r in found}
    return {f: by_name[name] for f in files if (name := re.sub(LOCAL, "file:/", f)) in by_name}


def headers(
    spark: SparkSession, files: list[str], names: list[str] | int | None, separator: str = SEPARATOR
) -> dict[str, list[str]]:
    """Files by their first line.

    It must hold ``names`` (or that many names, the same in all files) in any order. With None every file has the columns
    that its header names: layouts may differ from file to file.
    """
    found: dict[str, list[str]] = {}
    lines = header_lines(spark, files)
    for file in files:
        if file not in lines:
            raise ValueError(f"{file} is empty")
        header = lines[file].split(separator)
        if len(set(header)) < len(header):
            raise ValueError(f"the header of {file} has a column twice")
        if isinstance(names, int):
            if len(header) != names:
                raise ValueError(f"the header of {file} has {len(header)} columns, expected {names}")
            names = header
        if names is not None and sorted(header) != sorted(names):
            raise ValueError(f"the header of {file} has other columns: {sorted(set(header) ^ set(names))}")
        found.setdefault(lines[file], []).append(file)
    return found


# Local files are written with one slash or three.
LOCAL = r"^file:/+"


def _named(file: Column) -> Column:
    return F.regexp_replace(file, LOCAL, "file:/")


def _of_files(files: list[str]) -> Column:
    return _named(F.col("file")).isin([re.sub(LOCAL, "file:/", f) for f in files])


def by_layout(by_header: dict[str, list[str]], expression: Callable[[list[str]], str], separator: str = SEPARATOR) -> Column:
    """An expression that depends on the columns of a line's file."""
    cases = [(files, F.expr(expression(header.split(separator)))) for header, files in by_header.items()]
    if len(cases) == 1:
        return cases[0][1]
    chosen = F.when(_of_files(cases[0][0]), cases[0][1])
    for files, value in cases[1:]:
        chosen = chosen.when(_of_files(files), value)
    return chosen


def named_fields(lines: DataFrame, by_header: dict[str, list[str]], separator: str = SEPARATOR) -> DataFrame:
    """Typed rows of whole lines that have their ``file``, each read with its own file's header; united by name.

    One layout is the rule. Columns that a file does not have are null in its rows.
    """
    parts = []
    for header, files in by_header.items():
        own = lines if len(by_header) == 1 else lines.where(_of_files(files))
        parts.append(typed_fields(own.drop("file"), header.split(separator), separator))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def lines_with_file(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_lines(spark, paths).select("value", F.col("_metadata.file_path").alias("file"))


def read_dump(spark: SparkSession, path: str, column_count: int | None = len(ACCOUNTING_SCHEMA), separator: str = SEPARATOR) -> DataFrame:
    """Typed rows of a dump (a file, or a folder of them) without broken lines. Each file's columns are matched by its header.

    With None instead of a number, files may have different columns.
    """
    lines = lines_with_file(spark, path)
    found = headers(spark, lines.inputFiles(), column_count, separator)
    return named_fields(lines.where(by_layout(found, lambda names: is_whole(len(names), separator), separator)), found, separator)


def read_delimited(spark: SparkSession, path: str | list[str], schema: StructType = ACCOUNTING_SCHEMA, separator: str = SEPARATOR) -> DataFrame:
    """A clean delimited file with a header that must match ``schema``; bad values and other headers fail."""
    return (
        spark.read.schema(schema)
        .option("sep", separator)
        .option("header", True)
        .option("quote", "")
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )


def read_input_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Quotes in a quoted field are doubled, texts keep their spaces; nothing is null, a pair of quotes is the empty text."""
    # Empty fields count as this null value, which no file holds; so quoted empty texts stay what they are.
    return spark.read.schema(INPUT_SIZE_SCHEMA).options(sep=SEPARATOR, header=True, nullValue="\0", **FAITHFUL).csv(path)


def write_input_sizes(sizes: DataFrame, path: str) -> None:
    """The input-size table of all logs as delimited files with a header."""
    sizes.select(*INPUT_SIZE_SCHEMA.names).write.mode("overwrite").options(sep=SEPARATOR, header=True, **FAITHFUL).csv(path)
