"""Waiting time, running time and the share of a job that falls on a day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.functions.parsing import seconds_between, timestamp
from jobledger.operators.per_job import with_expressions

SUBMIT, START, END = timestamp("Submit"), timestamp("Start"), timestamp("End")


def as_date(day: str | dt.date) -> dt.date:
    return day if isinstance(day, dt.date) else dt.datetime.strptime(day, "%Y-%m-%d").date()


def date_literal(day: str | dt.date) -> str:
    return f"DATE'{as_date(day).isoformat()}'"


def add_wait_time(df: DataFrame) -> DataFrame:
    wait = seconds_between(SUBMIT, START)
    return with_expressions(df, {"wait_time_seconds": wait, "wait_time_hours": f"{wait} / 3600"})


def add_job_duration(df: DataFrame) -> DataFrame:
    return with_expressions(df, {"job_duration_seconds": seconds_between(START, END)})


def hours_on_day(start: str, end: str, day: str) -> str:
    """Hours between two zone-less timestamps that fall on ``day`` (a date); 0 when either is missing."""
    midnight = f"CAST({day} AS timestamp_ntz)"
    next_midnight = f"CAST(date_add({day}, 1) AS timestamp_ntz)"
    starts_today, ends_today = f"to_date({start}) = {day}", f"to_date({end}) = {day}"
    starts_before, ends_after = f"{start} < {midnight}", f"{end} >= {next_midnight}"
    return f"""CASE
        WHEN {starts_today} AND {ends_today} THEN {seconds_between(start, end)} / 3600
        WHEN {starts_before} AND {ends_today} THEN {seconds_between(midnight, end)} / 3600
        WHEN {starts_today} AND {ends_after} THEN {seconds_between(start, next_midnight)} / 3600
        WHEN {starts_before} AND {ends_after} THEN 24D
        ELSE 0D END"""


def add_daily_duration(df: DataFrame, day: str | dt.date) -> DataFrame:
    """Adds ``daily_duration_hours`` for one day and the day itself as ``date``."""
    date = date_literal(day)
    times = with_expressions(df, {"_start": START, "_end": END})
    hours = hours_on_day("_start", "_end", date)
    return with_expressions(times, {"daily_duration_hours": hours, "date": date}).drop("_start", "_end")


def daily_durations(df: DataFrame) -> DataFrame:
    """One row per job and day it ran on, for all days at once: ``date`` and ``daily_duration_hours``."""
    times = with_expressions(df, {"_start": START, "_end": END})
    first, last = "to_date(_start)", "to_date(_end)"
    days = times.selectExpr("*", f"explode(CASE WHEN {first} <= {last} THEN sequence({first}, {last}) END) AS date")
    return with_expressions(days, {"daily_duration_hours": hours_on_day("_start", "_end", "date")}).drop("_start", "_end")


def daily_totals(df: DataFrame) -> DataFrame:
    """Per day how many jobs ran on it (``jobs``) and for how many ``hours``, over all days at once.

    A sweep over days: a job gives its seconds on its first and last day, and events that say from which day on it counts
    and on which days it runs all day. Events of a day are added up before they are put in order, so what is shuffled, sorted
    and summed is bounded by the number of days, however long jobs run. Equal to adding up :func:`daily_durations`.
    """
    times = with_expressions(df, {"_start": START, "_end": END}).selectExpr("_start", "_end", "to_date(_start) AS first", "to_date(_end) AS last")
    begin, end = "CAST(last AS timestamp_ntz)", "CAST(date_add(first, 1) AS timestamp_ntz)"
    # (day, seconds on that day, jobs that begin to count, jobs that begin to run all day)
    events = f"""CASE WHEN first = last THEN array(
            struct(first AS date, {seconds_between('_start', '_end')} AS seconds, 1L AS counted, 0L AS whole),
            struct(date_add(last, 1) AS date, 0L AS seconds, -1L AS counted, 0L AS whole))
        WHEN first < last THEN array(
            struct(first AS date, {seconds_between('_start', end)} AS seconds, 1L AS counted, 0L AS whole),
            struct(date_add(first, 1) AS date, 0L AS seconds, 0L AS counted, 1L AS whole),
            struct(last AS date, {seconds_between(begin, '_end')} AS seconds, 0L AS counted, -1L AS whole),
            struct(date_add(last, 1) AS date, 0L AS seconds, -1L AS counted, 0L AS whole)) END"""
    by_day = times.selectExpr(f"inline({events})").groupBy("date").agg(*[F.sum(c).alias(c) for c in ("seconds", "counted", "whole")])
    # From here on there is at most a row per day.
    so_far = "OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)"
    running = by_day.selectExpr(
        "date", "lead(date) OVER (ORDER BY date) AS until", "seconds", f"sum(counted) {so_far} AS jobs", f"sum(whole) {so_far} AS whole"
    )
    days = running.where("jobs > 0").selectExpr("explode(sequence(date, date_sub(until, 1))) AS day", "date", "seconds", "jobs", "whole")
    # Seconds belong to the day of the event; the days up to the next event have the same jobs.
    return days.selectExpr("day AS date", "jobs", "CASE WHEN day = date THEN seconds ELSE 0 END / 3600 + whole * 24D AS hours")
