"""Job metrics relative to the size of the job's input files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.operators.per_job import with_expressions

MEGABYTE = 2**20


def add_input_sizes(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Left join with the input-size table, and minutes and requested memory per megabyte of input.

    A job without a row, or whose input size is 0, keeps null sizes; a job with several rows is repeated. Ids are
    compared as text. The size table has about one row per job, so it is never hinted as a broadcast side.
    """
    known = sizes.where("input_size_bytes != 0").selectExpr(
        "CAST(slurm_jobid AS string) AS slurm_jobid", "job_id", "rule_name AS rule_name_1", "input_size_bytes", "inputs"
    )
    return with_expressions(
        runs.join(known, F.expr("JobID = slurm_jobid"), "left"),
        {
            "MinPerMo": f"(ElapsedRaw / 60) / (input_size_bytes / {MEGABYTE}D)",
            "UsedRAMPerMo": f"(ReqMem / {MEGABYTE}D) / (input_size_bytes / {MEGABYTE}D)",
        },
    )
