"""The stored state of all jobs, into which new days are merged without shuffling the history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobledger.operators.job_state import KEY, job_state, jobs_of_state, merged
from jobledger.sources.publish import Folders


def _next(table: str) -> str:
    return f"{table}__next"


def recover(spark: SparkSession, table: str) -> None:
    """Ends a replacement that a lost driver left half done: the new state is complete once it is in the catalog."""
    if spark.catalog.tableExists(_next(table)):
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE {_next(table)}")
        else:
            spark.sql(f"ALTER TABLE {_next(table)} RENAME TO {table}")


def merge_plan(spark: SparkSession, rows: DataFrame, table: str) -> DataFrame:
    """The new state. The table is bucketed by job, so only the new rows are shuffled, to its buckets."""
    return merged(spark.table(table), job_state(rows))


def merge_days(spark: SparkSession, rows: DataFrame, table: str, path: str, buckets: int) -> None:
    """Adds accounting rows of any days to the state; the first call makes the table, with ``buckets`` buckets below ``path``.

    A bucket should be some hundred megabytes of state. The new state is written beside the old one, bucket by bucket, and
    takes its place when it is complete. Rows of a day may be merged again: that changes nothing.
    """
    recover(spark, table)
    there = spark.catalog.tableExists(table)
    state = merge_plan(spark, rows, table) if there else job_state(rows).repartition(buckets, KEY)
    place = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    state.write.option("path", place).bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(_next(table))
    if there:
        old = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"]
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"ALTER TABLE {_next(table)} RENAME TO {table}")
        Folders(spark, path).delete(old)
    else:
        spark.sql(f"ALTER TABLE {_next(table)} RENAME TO {table}")


def merged_jobs(spark: SparkSession, table: str) -> DataFrame:
    """One row per job of the whole history, with its efficiency, without a shuffle."""
    return jobs_of_state(spark.table(table))
