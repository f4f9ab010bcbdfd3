"""Daily cluster metrics and their calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from jobledger.operators.calendar import calendar, calendar_summary
from jobledger.operators.daily import for_day, job_facts, metrics_of_facts, needs_medians, period_medians, time_counts
from jobledger.operators.per_job import job_efficiency
from jobledger.operators.quantiles import unkept
from jobledger.operators.timecols import date_literal
from jobledger.plans.held import Held
from jobledger.sources.metrics import read_metrics, write_metrics, write_metrics_json
from jobledger.sources.store import read_day, read_days, write_days


def _facts(jobs: DataFrame, held: Held | None, names: list[str] | None) -> DataFrame:
    """A dozen narrow columns per job. Totals and medians both read them; without medians nothing needs to be held."""
    facts = job_facts(jobs)
    return held.keep(facts) if held and needs_medians(names) else facts


def daily_metrics(rows: DataFrame, day: str | dt.date, capacity: dict | None = None, held: Held | None = None) -> DataFrame:
    """The metrics of one day from the accounting rows of its dump, per QOS and for the cluster.

    With ``held`` the facts are computed once and kept until the caller closes it; without, each part computes its own.
    """
    return metrics_of_facts(_facts(for_day(job_efficiency(rows), day), held, None), capacity, keep=held.keep if held else unkept)


def daily_metrics_range(
    rows: DataFrame,
    first: str | dt.date | None = None,
    last: str | dt.date | None = None,
    names: list[str] | None = None,
    capacity: dict | None = None,
    held: Held | None = None,
) -> DataFrame:
    """The metrics (``names``, or all) of every day from ``first`` to ``last`` in one job; ``rows`` have a ``dt`` column.

    Only the rows of those days are read and rolled up, and only what is asked for is computed. A job that is in the dumps
    of several days counts on each of them, as it does when days are run one by one.
    """
    if first is not None:
        rows = rows.where(f"dt >= {date_literal(first)}")
    if last is not None:
        rows = rows.where(f"dt <= {date_literal(last)}")
    return metrics_of_facts(_facts(job_efficiency(rows, keys=["dt", "JobRoot"]), held, names), capacity, names, held.keep if held else unkept)


def store_time_counts(rows: DataFrame, path: str) -> None:
    """The exact counts of waiting and running times of the days in ``rows`` (with ``dt``); a rerun replaces its days."""
    write_days(time_counts(job_facts(job_efficiency(rows, keys=["dt", "JobRoot"]))), path, many_days=True)


def range_medians(spark: SparkSession, path: str, first: str | dt.date, last: str | dt.date, period: str | None = None) -> DataFrame:
    """Exact medians of waiting and running times from ``first`` to ``last``, by ``period`` (``week``, ``month``, ``year``) or of
    the whole range, per QOS and for the cluster. Only stored counts of those days are read, no accounting rows."""
    days = read_days(spark, path).where(f"dt BETWEEN {date_literal(first)} AND {date_literal(last)}")
    return period_medians(days, period)


def daily_report(
    spark: SparkSession, database: str, day: str | dt.date, metrics_path: str, json_path: str | None = None, capacity: dict | None = None
) -> DataFrame:
    """Reads a day of the database, computes its metrics and stores them; a rerun replaces the day."""
    with Held() as held:
        write_metrics(daily_metrics(read_day(spark, database, day), day, capacity, held), metrics_path, day)
    stored = read_metrics(spark, metrics_path, day, day)
    if json_path:
        write_metrics_json(stored, json_path, day)
    return stored


def metric_calendar(metrics: DataFrame, first: str | dt.date, last: str | dt.date, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The gap-filled series of some cluster metrics and its legend."""
    series = calendar(metrics, first, last, names)
    return series, calendar_summary(series)
