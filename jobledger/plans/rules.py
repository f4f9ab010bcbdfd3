"""Efficiency per workflow rule, and the complete report after a workflow run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from jobledger.operators.boxplot import box_points, box_statistics
from jobledger.operators.filters import name_contains_any, name_in, rows_of_jobs_named, with_rule
from jobledger.operators.input_sizes import add_input_sizes
from jobledger.operators.logs import log_input_sizes, run_ids
from jobledger.operators.per_job import add_rule_name, job_efficiency
from jobledger.operators.rules import distinct_rules, report_table, rule_statistics
from jobledger.plans.held import Held
from jobledger.schema import RULE_MEASURES, SIZED_RULE_MEASURES
from jobledger.sources.dumps import write_input_sizes
from jobledger.sources.store import write_table
from jobledger.sources.workflow_logs import read_log_lines


def rule_runs(
    rows: DataFrame, job_names: list[str] | DataFrame | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """The jobs of workflow rules, with input sizes if given.

    ``job_names`` is a list of name parts, a frame of exact names, or ``None`` for all jobs. Only rows of jobs that may
    have such a name are rolled up.
    """
    jobs = job_efficiency(rows_of_jobs_named(rows, job_names))
    jobs = name_in(jobs, job_names) if isinstance(job_names, DataFrame) else name_contains_any(jobs, job_names)
    runs = with_rule(add_rule_name(jobs))
    return runs if sizes is None else add_input_sizes(runs, sizes)


@dataclass
class RuleReport:
    """Everything the per-rule report shows, planned when asked for. ``close`` frees the shared rows."""

    runs: DataFrame
    measured: DataFrame
    statistics: DataFrame
    measures: list[str]
    box_method: str
    held: Held

    def table(self, measure: str) -> DataFrame:
        """Rule and statistics under the report headings, sorted by rule."""
        return report_table(self.statistics, measure)

    def rules(self) -> DataFrame:
        return distinct_rules(self.measured)

    def boxes(self, measure: str) -> DataFrame:
        return box_statistics(self.measured, ["rule_name"], measure, self.box_method)

    def points(self, measure: str) -> DataFrame:
        return box_points(self.measured, ["rule_name"], measure, self.box_method)

    def close(self) -> None:
        self.held.close()


def _narrow(runs: DataFrame, measures: list[str]) -> DataFrame:
    """The columns the statistics read."""
    return runs.select("rule_name", "JobRoot", *measures, "Elapsed", "QOS", "Account", "NodeList")


def rule_efficiency(
    rows: DataFrame,
    job_names: list[str] | DataFrame | None = None,
    sizes: DataFrame | None = None,
    output: str | None = None,
    box_method: str = "hazen",
    measures: list[str] | None = None,
    texts: bool = True,
) -> RuleReport:
    """Tables and box plots per rule. With ``output`` the job rows are also stored there, and read back from there.

    For single tables give their ``measures`` and leave out the ``texts``: nothing else is computed then.
    """
    measures = measures or RULE_MEASURES + (SIZED_RULE_MEASURES if sizes is not None else [])
    runs = rule_runs(rows, job_names, sizes)
    if output:
        write_table(runs, output)
        runs = rows.sparkSession.read.parquet(output)
    held = Held()
    measured = held.keep(_narrow(runs, measures))
    statistics = held.keep(rule_statistics(measured, measures, texts, held.keep))
    return RuleReport(runs, measured, statistics, measures, box_method, held)


def post_run_report(
    spark: SparkSession,
    logs: str | list[str],
    rows: DataFrame,
    manifest: DataFrame,
    output: str | None = None,
    sizes_output: str | None = None,
    base_folder: str | None = None,
) -> RuleReport:
    """From the logs of some workflow runs to their report: sizes and run ids from the logs, jobs by run id."""
    lines = read_log_lines(spark, logs)
    return report_of_lines(lines, rows, manifest, output, sizes_output, base_folder)


def report_of_lines(
    lines: DataFrame,
    rows: DataFrame,
    manifest: DataFrame,
    output: str | None = None,
    sizes_output: str | None = None,
    base_folder: str | None = None,
) -> RuleReport:
    sizes = log_input_sizes(lines, manifest, base_folder)
    if sizes_output:
        write_input_sizes(sizes, sizes_output)
    return rule_efficiency(rows, run_ids(lines).select("run_id"), sizes, output)
