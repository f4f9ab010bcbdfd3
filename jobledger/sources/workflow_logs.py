"""Workflow logs as numbered lines, and manifests of file sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_path(uri: Column) -> Column:
    """A file URI as the path it names: no scheme, no percent escapes."""
    path = F.regexp_replace(uri, r"^file:/+", "/")
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def plain_folder(uri: str) -> str:
    """A folder's URI as logs and manifests name it."""
    return re.sub(r"^file:/+", "/", uri.rstrip("/"))


def valid_text(value: Column) -> Column:
    """Text without the bytes that are not UTF-8."""
    return F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit("")))


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(``file``, ``chunk``, ``line_no``, ``value``) of all logs. A missing log fails.

    Logs are split like any text file: a chunk is one split, told by its offset, and line numbers grow within it.
    """
    return spark.read.text(paths).select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("line_no"),
        valid_text(F.col("value")).alias("value"),
    )


def file_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(``path``, ``length``) of all files below the given folders; contents are not read.

    Folders themselves are in no manifest, so an input that is a folder counts 0: the size of a folder entry says nothing
    about its contents. The driver lists the files; for very large trees store the manifest as a table and pass that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select(plain_path(F.col("path")).alias("path"), "length")
