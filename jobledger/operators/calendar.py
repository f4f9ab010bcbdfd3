"""Gap-free daily series between two dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.operators.timecols import as_date, date_literal
from jobledger.schema import CALENDAR_METRICS


def date_spine(spark: SparkSession, first: str | dt.date, last: str | dt.date) -> DataFrame:
    """Every day from ``first`` to ``last``, both included."""
    if as_date(first) > as_date(last):
        raise ValueError(f"the range is empty: {first} is after {last}")
    return spark.range(1).selectExpr(f"explode(sequence({date_literal(first)}, {date_literal(last)})) AS dt")


def calendar(metrics: DataFrame, first: str | dt.date, last: str | dt.date, names: list[str] | None = None) -> DataFrame:
    """(``dt``, ``has_data``, metrics): the cluster lines of ``metrics``, 0 where a day or a value is missing."""
    names = names or CALENDAR_METRICS
    days = date_spine(metrics.sparkSession, first, last)
    known = metrics.where(f"scope = 'global' AND dt BETWEEN {date_literal(first)} AND {date_literal(last)}")
    return days.join(known.selectExpr("dt", "true AS found", *names), "dt", "left").selectExpr(
        "dt", "found IS NOT NULL AS has_data", *[f"coalesce({n}, 0D) AS {n}" for n in names]
    )


def calendar_summary(series: DataFrame) -> DataFrame:
    """Per metric the smallest and largest value (the legend) and the number of days that have data."""
    names = [c for c in series.columns if c not in ("dt", "has_data")]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return (
        series.selectExpr("has_data", f"stack({len(names)}, {pairs}) AS (metric, value)")
        .groupBy("metric")
        .agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count_if("has_data").alias("days_with_data"))
    )
