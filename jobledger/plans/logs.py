"""Input sizes and run ids of workflow logs; records of logs that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.operators.logs import last_starts, log_input_sizes, log_records, numbered_lines, run_ids
from jobledger.sources.dumps import write_input_sizes
from jobledger.sources.publish import Folders, replace
from jobledger.sources.workflow_logs import file_manifest, read_log_lines

RUN = "run"
PROGRESS = "file string, length long, lines long"


def extract_logs(
    spark: SparkSession, logs: str | list[str], manifest: DataFrame, csv: str | None = None, base_folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(input sizes, run ids) of all logs; the sizes are also written as delimited files if ``csv`` is given."""
    lines = read_log_lines(spark, logs)
    sizes = log_input_sizes(lines, manifest, base_folder)
    if csv:
        write_input_sizes(sizes, csv)
    return sizes, run_ids(lines)


def _last_run(spark: SparkSession, folder: str) -> int:
    return max((int(n.partition("=")[2]) for n in Folders(spark, folder).names(folder) if n.startswith(f"{RUN}=")), default=0)


def extract_new_records(spark: SparkSession, logs: str | list[str], records: str, progress: str, final: bool = False) -> DataFrame:
    """Adds the records that logs have gained since the last run to the table ``records`` and gives the whole table.

    ``progress`` keeps for each log its length and the number of its lines that are done with. The record a log ends with may
    still grow: it is left for the next run, which begins with its first line; ``final`` takes it as it is. Logs whose length
    has not changed are not opened; a log that has become shorter is a new one. Of the others all lines are counted, and those
    not done with are put together. A run that fails can be repeated: it writes the same part of both tables.
    """
    last = _last_run(spark, progress)
    before = spark.read.schema(PROGRESS).parquet(f"{progress}/{RUN}={last}") if last else spark.createDataFrame([], PROGRESS)
    before = before.withColumnsRenamed({"length": "_length", "lines": "_lines"})
    files = file_manifest(spark, logs).withColumnsRenamed({"path": "file"}).join(before, "file", "left")
    same = F.col("length").eqNullSafe(F.col("_length"))
    done = F.when(F.col("length") >= F.col("_length"), F.col("_lines")).otherwise(F.lit(0)).alias("done")
    changed = files.where(F.lit(final) | ~same).select("file", "length", done)
    paths = [r["file"] for r in changed.select("file").collect()]  # the logs written to since the last run
    run = f"{RUN}={last + 1}"
    if paths:
        lines = numbered_lines(read_log_lines(spark, paths)).join(changed.select("file", "done"), "file").where("line_no >= done").drop("done")
        starts = last_starts(lines)
        found = log_records(lines).join(starts, "file").where(F.lit(final) | (F.col("first_line") < F.col("last_start")))
        found = found.select("file", "first_line", "slurm_jobid", "job_id", "rule_name", "inputs")
        replace(spark, records, 1, lambda place: found.write.parquet(f"{place}/{run}"))
        reached = F.col("n_lines") if final else F.coalesce("last_start", "done")
        totals = read_log_lines(spark, paths).groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"))
        now = changed.join(starts, "file", "left").join(totals, "file", "left").select("file", "length", F.coalesce(reached, F.lit(0)).alias("lines"))
        rest = before.join(changed, "file", "left_anti").select("file", F.col("_length").alias("length"), F.col("_lines").alias("lines"))
        replace(spark, progress, 1, lambda place: now.unionByName(rest).write.parquet(f"{place}/{run}"))
    return spark.read.parquet(records).drop(RUN)
