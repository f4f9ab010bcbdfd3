"""Selection of jobs by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.functions.parsing import job_root

def name_contains_any(jobs: DataFrame, parts: list[str] | None, column: str = "JobName") -> DataFrame:
    """Jobs whose name contains one of ``parts`` literally; ``None`` keeps every job.

    Runs on job rows, not on accounting rows: a step may carry another name than its job.
    """
    if parts is None:
        return jobs
    return jobs.where(reduce(lambda a, b: a | b, [F.col(column).contains(F.lit(p)) for p in parts], F.lit(False)))


def name_is_any(rows: DataFrame, names: list[str], column: str = "JobName") -> DataFrame:
    """Rows with exactly one of the given names; the test reaches the Parquet scan."""
    return rows.where(F.col(column).isin(list(names)))


def name_in(jobs: DataFrame, names: DataFrame, column: str = "JobName") -> DataFrame:
    """Jobs whose name is in the one-column frame ``names`` (run ids taken from workflow logs)."""
    other = names.select(F.col(names.columns[0]).alias("_name"))
    return jobs.join(other, jobs[column] == other["_name"], "left_semi")


def rows_of_jobs_named(rows: DataFrame, names: list[str] | DataFrame | None) -> DataFrame:
    """All rows of the jobs that have some row with one of the names.

    A job whose own name fits is among them, so selecting rows like this before the roll-up and jobs by name after it
    gives the same jobs as rolling everything up. The name test reaches the scan; only job numbers are shuffled for it.
    """
    if names is None:
        return rows
    named = name_in(rows, names) if isinstance(names, DataFrame) else name_contains_any(rows, names)
    roots = named.selectExpr(f"{job_root('JobID')} AS _root").distinct()
    return rows.join(roots, F.expr(f"{job_root('JobID')} <=> _root"), "left_semi")


def with_rule(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("rule_name").isNotNull())
