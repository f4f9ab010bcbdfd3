"""The daily metrics store: Parquet table and JSON documents per day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.operators.daily import merged_scopes
from jobledger.operators.timecols import as_date
from jobledger.schema import DAILY_METRICS
from jobledger.sources.publish import replace
from jobledger.sources.store import day_of_path, read_days, write_day, write_days


def write_metrics(metrics: DataFrame, path: str, day: str | dt.date | None = None) -> None:
    """Stores metrics by day; a rerun replaces its days only. A single ``day`` is replaced even if it has no metrics."""
    write_days(metrics, path, many_days=True) if day is None else write_day(metrics, path, day)


def read_metrics(spark: SparkSession, path: str, first: str | dt.date, last: str | dt.date) -> DataFrame:
    return read_days(spark, path).where(F.col("dt").between(F.lit(as_date(first)), F.lit(as_date(last))))


def day_documents(metrics: DataFrame) -> DataFrame:
    """(``dt``, ``value``): the JSON document of each day, ``{qos: {label: value}, "global": {…}}``."""
    entry = F.struct(*[F.col(name).alias(label) for name, label in DAILY_METRICS.items()])
    # A document holds one entry per service class of the cluster, a handful of rows.
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("name"), entry.alias("m")))))
    document = F.to_json(entries, {"ignoreNullFields": "false"})
    return merged_scopes(metrics).groupBy("dt").agg(document.alias("value"))


def write_metrics_json(metrics: DataFrame, path: str, day: str | dt.date | None = None) -> None:
    days = day_documents(metrics)
    if day is not None:
        return write_day(days, path, day, text=True)
    replace(metrics.sparkSession, path, 1, lambda place: days.write.partitionBy("dt").text(place))


def read_documents(spark: SparkSession, path: str | list[str], first: str | dt.date, last: str | dt.date) -> DataFrame:
    """(``dt``, ``value``): the documents between two dates; files of other days are not opened.

    The day is the partition of ``dt=…`` folders, or the name of files called ``YYYY-MM-DD.json`` in one folder.
    """
    documents = spark.read.text(path, wholetext=True)
    first, last = as_date(first), as_date(last)
    if "dt" in documents.columns:
        return documents.where(F.col("dt").cast("date").between(F.lit(first), F.lit(last))).select(F.col("dt").cast("date").alias("dt"), "value")
    documents = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    named = documents.where(F.col("_metadata.file_name").between(f"{first}.json", f"{last}.json"))
    return named.select(day_of_path(F.col("_metadata.file_path")).alias("dt"), "value")


def read_metrics_json(spark: SparkSession, path: str | list[str], first: str | dt.date, last: str | dt.date) -> DataFrame:
    """Cluster lines of the JSON documents between two dates, with the column names of the metrics table.

    Days without a cluster line are left out. Of a document only the cluster line is taken out of its variant.
    """
    documents = read_documents(spark, path, first, last)
    lines = documents.select("dt", F.variant_get(F.parse_json("value"), "$.global", "map<string,double>").alias("m")).where("m IS NOT NULL")
    return lines.select("dt", F.lit("global").alias("scope"), *[F.col("m")[label].alias(name) for name, label in DAILY_METRICS.items()])
