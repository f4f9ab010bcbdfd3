"""Efficiency per job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from jobledger.operators.per_job import conform, job_efficiency, job_report
from jobledger.sources.store import write_csv, write_table


def efficiency_per_job(rows: DataFrame, parquet: str | None = None, csv: str | None = None) -> DataFrame:
    """The per-job export: all report columns, memory in gigabytes and the two efficiency percents."""
    report = job_report(job_efficiency(conform(rows)))
    if parquet:
        write_table(report, parquet)
    if csv:
        write_csv(report, csv)
    return report
