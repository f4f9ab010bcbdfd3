"""The accounting database and the job tables: Parquet, partitioned by day and, for accounting rows, by dump.

Batch and streamed ingest write the same folders with the batch writer, ``dt=YYYY-MM-DD/dump=NAME``; a rerun of a dump
replaces its own folder and nothing else, also when no row is left. Every write is published by renaming
(``sources.publish``), so a run that fails leaves the old rows, and columns may change from dump to dump
(``sources.layouts``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.operators.filters import name_is_any
from jobledger.operators.timecols import as_date
from jobledger.sources import layouts
from jobledger.sources.publish import replace

# Delimited files as most tools write them; Spark's own defaults trim texts and escape quotes with backslashes.
FAITHFUL = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
DAY = "dt"
DUMP = "dump"


class MissingDay(LookupError):
    """The database has no rows for the requested day."""


def day_of_path(path: Column) -> Column:
    """The last ``YYYY-MM-DD`` of a path (``…/dt=2026-02-24/part-0.parquet`` or ``…/2026-02-24.parquet``) as a date."""
    return F.regexp_extract(path, r".*(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


# Jobs are looked up by name over the whole history: each file says which names it does not hold.
LOOKUP = {"parquet.bloom.filter.enabled#JobName": "true", "parquet.bloom.filter.expected.ndv#JobName": "100000"}


def _lookup(df: DataFrame) -> dict[str, str]:
    return LOOKUP if "JobName" in df.columns else {}


def write_days(df: DataFrame, path: str, many_days: bool = False) -> None:
    """Writes rows partitioned by ``dt``; days that are present are replaced, other days stay.

    Rows of one dump are written where they are. With ``many_days`` rows are first brought together by day, or every
    task would write a small file for every day; AQE splits large days and joins small ones.
    """
    layouts.register(df.sparkSession, path, df.schema, [DAY])
    rows = df.hint("rebalance", DAY) if many_days else df
    replace(df.sparkSession, path, 1, lambda place: rows.write.partitionBy(DAY).parquet(place))


def write_rows(df: DataFrame, path: str, dump: str = "rows") -> None:
    """Accounting rows of many days as one dump; that dump's days that are present are replaced."""
    layouts.register(df.sparkSession, path, df.schema, [DAY])
    rows = df.withColumn(DUMP, F.lit(dump)).hint("rebalance", DAY)
    replace(df.sparkSession, path, 2, lambda place: rows.write.options(**_lookup(df)).partitionBy(DAY, DUMP).parquet(place))


def write_day(df: DataFrame, path: str, day: str | dt.date, text: bool = False) -> None:
    """Rows of one day; the day is replaced even if there are none."""
    if not text:
        layouts.register(df.sparkSession, path, df.schema, [DAY])
    writer, folder = df.drop(DAY).write, f"{DAY}={as_date(day).isoformat()}"
    replace(df.sparkSession, path, 1, lambda place: getattr(writer, "text" if text else "parquet")(f"{place}/{folder}"))


def write_dump(df: DataFrame, path: str, day: str | dt.date, dump: str) -> None:
    """Rows of one dump of one day, written where they are; the dump is replaced even if there are none."""
    layouts.register(df.sparkSession, path, df.schema)
    folder = f"{DAY}={as_date(day).isoformat()}/{DUMP}={dump}"
    replace(df.sparkSession, path, 2, lambda place: df.write.options(**_lookup(df)).parquet(f"{place}/{folder}"))


def write_dumps(df: DataFrame, path: str, dumps: list[tuple[dt.date, str]]) -> None:
    """Rows of several dumps (``dt`` and ``dump``); of those of ``dumps`` that have no rows nothing is left."""
    layouts.register(df.sparkSession, path, df.schema, [DAY, DUMP])
    written = replace(df.sparkSession, path, 2, lambda place: df.write.options(**_lookup(df)).partitionBy(DAY, DUMP).parquet(place))
    for day, dump in dumps:
        if f"{DAY}={day.isoformat()}/{DUMP}={dump}" not in written:
            write_dump(df.drop(DAY, DUMP).limit(0), path, day, dump)


def dump_name(path: Column) -> Column:
    """File name without its ending; it may hold letters, digits, dots, dashes and underscores."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", ""), r"[^A-Za-z0-9._-]", "_")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The whole database; filters on ``dt`` prune partitions. Columns of all its layouts, null where a dump has none."""
    return _parquet(spark, path).drop(DUMP)


def read_day(spark: SparkSession, path: str, day: str | dt.date) -> DataFrame:
    """The rows of one day: its partition, or the file ``YYYY-MM-DD.parquet`` of a database that has one file per day.

    Either way only the files of that day are read.
    """
    date = as_date(day)
    rows = _parquet(spark, path).drop(DUMP)
    if DAY in rows.columns:
        rows = rows.where(F.col(DAY) == F.lit(date))
    else:
        rows = rows.where(F.col("_metadata.file_name") == f"{date.isoformat()}.parquet").withColumn(DAY, F.lit(date))
    if rows.isEmpty():
        raise MissingDay(f"no accounting rows for {day} in {path}")
    return rows


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    # A database may hold other files beside its Parquet files, such as metrics documents.
    reader, schema = spark.read.option("pathGlobFilter", "*.parquet"), layouts.stored_schema(spark, path)
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files, folders or wildcards as one frame, united by column name; the day in a file's path becomes ``dt`` if
    rows have none."""
    rows = spark.read.options(pathGlobFilter="*.parquet", recursiveFileLookup=True, mergeSchema=True).parquet(*paths)
    if DAY in rows.columns:
        return rows
    return rows.select("*", day_of_path(F.col("_metadata.file_path")).alias(DAY))


def read_jobs_named(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of jobs with exactly one of the names, over the whole history.

    The names reach the scan, where each file's Bloom filter of names tells which row groups need not be read.
    """
    return name_is_any(read_days(spark, path), names)


def write_table(df: DataFrame, path: str) -> None:
    """A plain Parquet copy (the filtered run, the per-job export)."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header and doubled quotes; spaces at the ends of texts stay, and empty texts differ from nulls."""
    df.write.mode("overwrite").options(header=True, **FAITHFUL).csv(path)


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "JobRoot") -> None:
    """Stores rows bucketed by job, so that per-job aggregation later needs no shuffle.

    Rows are first brought to their bucket, which gives one file per bucket instead of one per task and bucket.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )
