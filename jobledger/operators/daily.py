"""Daily cluster metrics: one row per day for the whole cluster and one per service class (QOS)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.functions.parsing import gigabytes, seconds_between
from jobledger.operators.joining import join_on
from jobledger.operators.per_job import with_expressions
from jobledger.operators.quantiles import Keep, quantiles_of_frequencies, unkept, unpivoted_frequencies
from jobledger.operators.timecols import END, START, SUBMIT, add_daily_duration, add_job_duration, add_wait_time, date_literal
from jobledger.schema import DAILY_METRICS, DEFAULT_CAPACITY

SCOPE = ["dt", "scope", "QOS"]
TIMES = ["wait", "duration"]
# Every per-QOS row counts once for its QOS and once for the whole cluster.
BOTH_SCOPES = "inline(array(struct('qos' AS scope, QOS AS QOS), struct('global' AS scope, CAST(NULL AS string) AS QOS)))"


def with_time_columns(jobs: DataFrame, day: str | dt.date) -> DataFrame:
    """The job rows of one day with their hours on it, waiting time and duration."""
    return jobs.transform(add_daily_duration, day).transform(add_wait_time).transform(add_job_duration)


def for_day(jobs: DataFrame, day: str | dt.date) -> DataFrame:
    return with_expressions(jobs, {"dt": date_literal(day)})


def job_facts(jobs: DataFrame) -> DataFrame:
    """The few numbers per job that the metrics need, from job rows with a ``dt`` date column."""
    times = with_expressions(jobs, {"_submit": SUBMIT, "_start": START, "_end": END})
    return times.selectExpr(
        "dt",
        "QOS",
        "TotalCPU_seconds AS cpu_seconds",
        f"{gigabytes('MaxRSS')} * ElapsedRaw AS gb_seconds",
        f"{seconds_between('_submit', '_start')} AS wait",
        f"{seconds_between('_start', '_end')} AS duration",
        "JobID IS NOT NULL AS counted",
        "to_date(_submit) = dt AS submitted",
        "to_date(_start) = dt AS started",
        "to_date(_end) = dt AS ended",
        "State",
    )


def _both_scopes(df: DataFrame) -> DataFrame:
    return df.selectExpr("dt", BOTH_SCOPES, *[c for c in df.columns if c not in SCOPE])


def _medians(facts: DataFrame, keep: Keep) -> DataFrame:
    freq = _both_scopes(keep(time_counts(facts)))
    medians = quantiles_of_frequencies(freq, [*SCOPE, "measure"], {"median": 0.5}, keep=keep)
    return medians.groupBy(*SCOPE).agg(
        *[F.expr(f"max(median) FILTER (WHERE measure = '{m}') AS {m}_median") for m in TIMES]
    )


def time_counts(facts: DataFrame) -> DataFrame:
    """(``dt``, ``QOS``, ``measure``, ``value``, ``n``): how often each waiting and running time came, per day and class.

    Counts of several days, classes or parts of a day add up, so stored ones give exact medians of any span without its jobs.
    """
    return unpivoted_frequencies(facts, ["dt", "QOS"], TIMES)


def period_medians(counts: DataFrame, period: str | None = None) -> DataFrame:
    """(``period``, ``scope``, ``QOS``, ``wait_median``, ``duration_median``) from :func:`time_counts`.

    ``period`` is a unit of ``date_trunc`` (``week``, ``month``, ``year``), or None for all days together (null).
    """
    begins = f"CAST(date_trunc('{period}', dt) AS date)" if period else "CAST(NULL AS date)"
    added = counts.selectExpr(f"{begins} AS dt", "QOS", "measure", "value", "n").groupBy("dt", "QOS", "measure", "value").agg(F.sum("n").alias("n"))
    medians = quantiles_of_frequencies(_both_scopes(added), [*SCOPE, "measure"], {"median": 0.5})
    return medians.groupBy(F.col("dt").alias("period"), "scope", "QOS").agg(
        *[F.expr(f"max(median) FILTER (WHERE measure = '{m}') AS {m}_median") for m in TIMES]
    )


def needs_medians(names: list[str] | None) -> bool:
    return names is None or any(n.endswith("_median") for n in names)


def metrics_of_facts(facts: DataFrame, capacity: dict | None = None, names: list[str] | None = None, keep: Keep = unkept) -> DataFrame:
    """All metrics for all days in ``facts``: (``dt``, ``scope``, ``QOS``, 19 metrics, ``jobs_ended_on_day``), or ``names`` of them.

    For medians ``facts`` is read twice, so pass a persisted or stored frame; ``keep`` (``Held.keep``) keeps the counts
    that medians are taken from. Totals are aggregated per QOS
    and the cluster line is added up from those, so no job row is expanded before the first aggregation.

    ``jobs_ended`` counts jobs that *started* on the day, like ``jobs_started``; this is the reported metric.
    ``jobs_ended_on_day`` counts the jobs whose end falls on the day.
    """
    capacity = {**DEFAULT_CAPACITY, **(capacity or {})}
    counts = {
        "jobs_submitted": "submitted",
        "jobs_started": "started",
        "jobs_ended_on_day": "ended",
        "jobs_completed": "State = 'COMPLETED'",
        "jobs_failed": "State = 'FAILED'",
        "jobs_preempted": "State = 'PREEMPTED'",
    }
    # Column -> (aggregate over jobs, aggregate over the QOS lines).
    steps = {name: (f"sum({name})", f"coalesce(sum({name}), 0)") for name in ("cpu_seconds", "gb_seconds")}
    steps |= {name: (f"count_if(counted AND {condition})", f"sum({name})") for name, condition in counts.items()}
    for m in TIMES:
        steps |= {f"{m}_sum": (f"sum({m})", f"sum({m}_sum)"), f"{m}_count": (f"count({m})", f"sum({m}_count)")}
        steps |= {f"{m}_{f}": (f"{f}({m})", f"{f}({m}_{f})") for f in ("min", "max")}
    per_qos = facts.groupBy("dt", "QOS").agg(*[F.expr(f"{job} AS {name}") for name, (job, _) in steps.items()])
    totals = _both_scopes(per_qos).groupBy(*SCOPE).agg(*[F.expr(f"{line} AS {name}") for name, (_, line) in steps.items()])
    derived = {
        "cpu_hours": "cpu_seconds / 3600",
        "cpu_usage_percent": f"cpu_seconds / {float(capacity['cpu_seconds'])}D * 100",
        "ram_usage_percent": f"gb_seconds / {float(capacity['gb_seconds'])}D * 100",
        "wait_mean": "wait_sum / nullif(wait_count, 0)",
        "duration_mean": "duration_sum / nullif(duration_count, 0)",
        "jobs_ended": "jobs_started",
    }
    complete = with_expressions(totals, derived)
    if needs_medians(names):
        complete = join_on(complete, _medians(facts, keep), SCOPE, "left")
    return complete.select(*SCOPE, *(names or [*DAILY_METRICS, "jobs_ended_on_day"]))


def merged_scopes(metrics: DataFrame) -> DataFrame:
    """One entry per day and name: the QOS names and ``global``, which wins over a QOS of that name."""
    # A null QOS is written as "null"; a QOS really called that takes precedence over it.
    name = "CASE WHEN scope = 'global' THEN 'global' ELSE coalesce(QOS, 'null') END AS name"
    rank = "CASE WHEN scope = 'global' THEN 2 WHEN QOS IS NOT NULL THEN 1 ELSE 0 END AS rank"
    columns = [c for c in metrics.columns if c not in SCOPE]
    named = metrics.selectExpr("dt", name, rank, f"struct({', '.join(columns)}) AS m")
    return named.groupBy("dt", "name").agg(F.max_by("m", "rank").alias("m")).select("dt", "name", "m.*")
