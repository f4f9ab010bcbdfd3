"""

The driver's tables hold no accounting data, so queries run on accounting rows, workflow logs and dump lines that
Spark derives from all of ``orders`` and ``lineitem`` (see ``jobledger/sources/star_tables.py``).
"""

from __future__ import annotations

import importlib.util
import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from jobledger.functions import display
from jobledger.operators import filters, lines, per_job, timecols
from jobledger.operators.boxplot import box_points, box_statistics
from jobledger.operators.logs import add_chunks, log_input_sizes, log_records, run_ids
from jobledger.operators.rules import distinct_rules, shown_table
from jobledger.plans import daily, ingest, job_state, jobs, rules
from jobledger.plans.held import Held
from jobledger.plans.logs import extract_new_records
from jobledger.schema import CALENDAR_METRICS, DAILY_METRICS, RULE_MEASURES, SIZED_RULE_MEASURES
from jobledger.session import scratch_path
from jobledger.sources import dumps, metrics, star_tables, store
from jobledger.sources.publish import Folders
from jobledger.sources.workflow_logs import file_manifest, plain_folder, read_log_lines
from jobledger.streaming.ingest import ingest_new_dumps

DAY = oracles.REPORT_DAY
RANGE = oracles.RANGE
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def rounded(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Fractions with six digits and dates as text, so that both engines show the same values."""
    cells = []
    for name, kind in df.dtypes:
        quoted = f"`{name}`"
        if kind == "double":
            cells.append(f"round({quoted}, {(digits or {}).get(name, 6)}) AS {quoted}")
        elif kind == "date":
            cells.append(f"CAST({quoted} AS string) AS {quoted}")
        else:
            cells.append(quoted)
    return df.selectExpr(*cells)


def _efficiency(spark, sf_dir):
    return per_job.job_efficiency(star_tables.accounting(spark, sf_dir))


def _lines(spark, sf_dir):
    return add_chunks(star_tables.log_lines(spark, sf_dir))


def _report(spark, sf_dir, sized=False, **options):
    sizes = star_tables.input_sizes(spark, sf_dir) if sized else None
    return rules.rule_efficiency(star_tables.accounting(spark, sf_dir), sizes=sizes, **options)


def _finished(df, held):
    """The result as a stored table (a row per rule, or per day and class), so that what it was made from can be let go."""
    with held:
        path = scratch_path(df.sparkSession, "result")
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _metrics(df):
    return rounded(df, {"gb_seconds": 3})


# Parsing


@query("job_kind")
def job_kind(spark, sf_dir):
    rows = per_job.add_job_kind(star_tables.accounting(spark, sf_dir))
    return rows.select("JobID", "JobRoot", "JobInfoType")


@query("size_units")
def size_units(spark, sf_dir):
    rows = per_job.add_size_unit(star_tables.accounting(spark, sf_dir), "MaxRSS", "ReqMem")
    return rows.selectExpr(
        "JobID", "MaxRSS AS rss_digits", "MaxRSS_unit AS rss_unit", "ReqMem AS req_digits", "ReqMem_unit AS req_unit"
    )


@query("size_bytes")
def size_bytes(spark, sf_dir):
    names = ("MaxRSS", "ReqMem")
    rows = per_job.size_to_bytes(per_job.add_size_unit(star_tables.accounting(spark, sf_dir), *names), *names)
    rows = per_job.bytes_to_gigabytes(rows, *names, keep_original=True)
    return rounded(
        rows.selectExpr("JobID", "MaxRSS AS rss_bytes", "ReqMem AS req_bytes", "MaxRSS_G AS rss_gb", "ReqMem_G AS req_gb")
    )


@query("total_cpu_seconds")
def total_cpu_seconds(spark, sf_dir):
    rows = per_job.add_cpu_seconds(star_tables.accounting(spark, sf_dir))
    return rows.selectExpr("JobID", "TotalCPU", "TotalCPU_seconds AS cpu_seconds")


@query("rule_name_parse")
def rule_name_parse(spark, sf_dir):
    return per_job.add_rule_name(star_tables.accounting(spark, sf_dir)).select("JobID", "rule_name", "wildcards")


# Jobs


@query("per_job")
def per_job_rows(spark, sf_dir):
    return _efficiency(spark, sf_dir).select("JobRoot", *oracles.TEXTS, *oracles.NUMBERS)


@query("job_efficiency")
def job_efficiency(spark, sf_dir):
    return rounded(
        _efficiency(spark, sf_dir).selectExpr(
            "JobRoot", "JobID", "User", "State", "QOS", "ReqMem_G AS req_gb", "MaxRSS_G AS rss_gb",
            "MemEfficiencyPercent AS mem_percent", "TotalCPU_seconds AS cpu_seconds", "CPUEfficiencyPercent AS cpu_percent",
        )
    )


@query("job_report")
def job_report(spark, sf_dir):
    return rounded(jobs.efficiency_per_job(star_tables.accounting(spark, sf_dir)))


@query("wait_times")
def wait_times(spark, sf_dir):
    times = timecols.add_wait_time(_efficiency(spark, sf_dir))
    return rounded(times.select("JobRoot", "JobID", "wait_time_seconds", "wait_time_hours"))


@query("job_durations")
def job_durations(spark, sf_dir):
    return timecols.add_job_duration(_efficiency(spark, sf_dir)).select("JobRoot", "JobID", "job_duration_seconds")


@query("daily_duration")
def daily_duration(spark, sf_dir):
    hours = timecols.add_daily_duration(_efficiency(spark, sf_dir), DAY)
    return rounded(hours.select("JobRoot", "JobID", "daily_duration_hours", "date"))


@query("daily_duration_all_days")
def daily_duration_all_days(spark, sf_dir):
    return rounded(timecols.daily_totals(_efficiency(spark, sf_dir)))


@query("merged_job_state")
def merged_job_state(spark, sf_dir):
    """The dumps of all days, merged into the state of jobs in three parts, one of them twice."""
    table, path, dumps_ = f"job_state_{uuid.uuid4().hex}", scratch_path(spark, "job-state"), scratch_path(spark, "parts")
    # The dumps are made once: each merge reads its own part of them.
    star_tables.accounting_by_day(spark, sf_dir).withColumn("part", F.expr("month(dt) % 3")).write.partitionBy("part").parquet(dumps_)
    rows = spark.read.parquet(dumps_)
    # A quarter of a million jobs are some hundred megabytes of state.
    buckets = max(8, spark.read.parquet(os.path.join(sf_dir, "orders.parquet")).count() // 250_000)
    for part in (2, 0, 1, 0):
        job_state.merge_days(spark, rows.where(f"part = {part}").drop("part"), table, path, buckets=buckets)
    return job_state.merged_jobs(spark, table).select("JobRoot", *oracles.TEXTS, *oracles.NUMBERS)


# Daily metrics


@query("daily_metrics")
def daily_metrics(spark, sf_dir):
    held = Held()
    return _finished(_metrics(daily.daily_metrics(star_tables.accounting(spark, sf_dir), DAY, held=held)), held)


@query("daily_metrics_qos")
def daily_metrics_qos(spark, sf_dir):
    return daily_metrics(spark, sf_dir).where("scope = 'qos'")


@query("daily_metrics_global")
def daily_metrics_global(spark, sf_dir):
    return daily_metrics(spark, sf_dir).where("scope = 'global'")


@query("daily_metrics_all_days")
def daily_metrics_all_days(spark, sf_dir):
    held = Held()
    return _finished(_metrics(daily.daily_metrics_range(star_tables.accounting_by_day(spark, sf_dir), held=held)), held)


@query("metrics_json_range")
def metrics_json_range(spark, sf_dir):
    path = scratch_path(spark, "metrics-json")
    with Held() as held:
        metrics.write_metrics_json(daily.daily_metrics_range(star_tables.accounting_by_day(spark, sf_dir), held=held), path)
    whole = [n for n in DAILY_METRICS if n.startswith("jobs_") or n.endswith(("_min", "_max")) or n == "cpu_seconds"]
    stored = metrics.read_metrics_json(spark, path, *RANGE)
    numbers = [f"CAST({n} AS bigint) AS {n}" if n in whole else n for n in DAILY_METRICS]
    return _metrics(stored.selectExpr("dt", *numbers))


def _calendar(spark, sf_dir):
    found = daily.daily_metrics_range(star_tables.accounting_by_day(spark, sf_dir), *RANGE, names=CALENDAR_METRICS)
    return daily.metric_calendar(found, *RANGE)


@query("metric_calendar")
def metric_calendar(spark, sf_dir):
    return rounded(_calendar(spark, sf_dir)[0])


@query("stored_calendar")
def stored_calendar(spark, sf_dir):
    """The calendar of metrics that were stored day by day before."""
    path = scratch_path(spark, "metrics")
    with Held() as held:
        metrics.write_metrics(daily.daily_metrics_range(star_tables.accounting_by_day(spark, sf_dir), held=held), path)
    return rounded(daily.metric_calendar(metrics.read_metrics(spark, path, *RANGE), *RANGE)[0])


@query("stored_daily_report")
def stored_daily_report(spark, sf_dir):
    """A day of the database to stored metrics, twice: the second run replaces the first."""
    database, path = scratch_path(spark, "database"), scratch_path(spark, "metrics")
    store.write_rows(star_tables.accounting_by_day(spark, sf_dir), database)
    for _ in range(2):
        stored = daily.daily_report(spark, database, DAY, path, json_path=scratch_path(spark, "metrics-json"))
    return _metrics(stored)


@query("period_medians")
def period_medians(spark, sf_dir):
    """Exact medians by year from stored counts."""
    path = scratch_path(spark, "time-counts")
    daily.store_time_counts(star_tables.accounting_by_day(spark, sf_dir), path)
    return rounded(daily.range_medians(spark, path, *RANGE, period="year"))


@query("calendar_summary")
def calendar_summary(spark, sf_dir):
    legend = _calendar(spark, sf_dir)[1]
    shown = [f"{display.legend_number(n)} AS {n}" for n in ("min_value", "max_value")]
    return legend.selectExpr("metric", *shown, "days_with_data")


# Selection of jobs


@query("job_name_filter")
def job_name_filter(spark, sf_dir):
    parts = ["n-3", "run-7"]
    rows = filters.rows_of_jobs_named(star_tables.accounting(spark, sf_dir), parts)
    return filters.name_contains_any(per_job.job_efficiency(rows), parts).select("JobRoot", "JobID", "JobName")


@query("job_name_exact")
def job_name_exact(spark, sf_dir):
    rows = filters.name_is_any(star_tables.accounting(spark, sf_dir), ["run-1", "run-2"])
    return rows.select("JobID", "JobName", "State")


@query("job_name_history")
def job_name_history(spark, sf_dir):
    """Rows of two jobs by name, from the stored history."""
    database = scratch_path(spark, "database")
    store.write_rows(star_tables.accounting_by_day(spark, sf_dir), database)
    return rounded(store.read_jobs_named(spark, database, ["run-late", "run-3"]).select("JobID", "JobName", "State", "dt"))


@query("run_id_jobs")
def run_id_jobs(spark, sf_dir):
    names = run_ids(_lines(spark, sf_dir)).select("run_id")
    rows = filters.rows_of_jobs_named(star_tables.accounting(spark, sf_dir), names)
    return filters.name_in(per_job.job_efficiency(rows), names).select("JobRoot", "JobID", "JobName")


# Rules


@query("rule_runs")
def rule_runs(spark, sf_dir):
    runs = rules.rule_runs(star_tables.accounting(spark, sf_dir))
    return rounded(runs.selectExpr("JobRoot", "JobID", "rule_name", "wildcards", "MemEfficiencyPercent AS mem_percent"))


@query("distinct_rules")
def distinct_rules_of_runs(spark, sf_dir):
    return distinct_rules(rules.rule_runs(star_tables.accounting(spark, sf_dir)))


def _statistics(report):
    # Whole-number minima and maxima are compared as fractions, like the other statistics.
    names = {f"ElapsedRaw_{s}" for s in ("min", "max")}
    table = report.statistics
    shown = rounded(table.selectExpr(*[f"CAST({n} AS double) AS {n}" if n in names else n for n in table.columns]))
    return _finished(shown, report.held)


@query("rule_statistics")
def rule_statistics_of_runs(spark, sf_dir):
    return _statistics(_report(spark, sf_dir))


@query("rule_statistics_sized")
def rule_statistics_sized(spark, sf_dir):
    return _statistics(_report(spark, sf_dir, sized=True))


@query("input_size_join")
def input_size_join(spark, sf_dir):
    runs = rules.rule_runs(star_tables.accounting(spark, sf_dir), sizes=star_tables.input_sizes(spark, sf_dir))
    return rounded(
        runs.select(
            "JobRoot", "JobID", "rule_name", "slurm_jobid", "job_id", "rule_name_1", "input_size_bytes", "inputs", "MinPerMo", "UsedRAMPerMo"
        )
    )


def _table(measure: str) -> Query:
    def run(spark, sf_dir):
        report = _report(spark, sf_dir, sized=measure in SIZED_RULE_MEASURES, measures=[measure], texts=False)
        table = report.table(measure)
        first, *rest = table.columns
        return _finished(rounded(table.selectExpr(f"`{first}`", *[f"CAST(`{c}` AS double) AS `{c}`" for c in rest])), report.held)

    return run


QUERIES["memory_table"], QUERIES["cpu_table"], QUERIES["runtime_table"] = map(_table, RULE_MEASURES)
QUERIES["relative_memory_table"], QUERIES["relative_runtime_table"] = map(_table, SIZED_RULE_MEASURES)


@query("shown_cpu_table")
def shown_cpu_table(spark, sf_dir):
    report = _report(spark, sf_dir, measures=["CPUEfficiencyPercent"], texts=False)
    return _finished(shown_table(report.table("CPUEfficiencyPercent")), report.held)


@query("efficiency_bands")
def efficiency_bands(spark, sf_dir):
    colours = [
        f"{display.band_colour(f'{m}EfficiencyPercent')} AS {m.lower()}_colour" for m in ("Mem", "CPU")
    ]
    return _efficiency(spark, sf_dir).selectExpr("JobRoot", "JobID", *colours)


@query("duration_labels")
def duration_labels(spark, sf_dir):
    times = timecols.add_job_duration(_efficiency(spark, sf_dir))
    label, shown = display.duration_label("job_duration_seconds"), display.two_decimals("job_duration_seconds")
    return times.selectExpr("JobRoot", "JobID", f"{label} AS label", f"{shown} AS shown")


def _boxes(measure: str, method: str, sized: bool = False) -> Query:
    def run(spark, sf_dir):
        sizes = star_tables.input_sizes(spark, sf_dir) if sized else None
        runs = rules.rule_runs(star_tables.accounting(spark, sf_dir), sizes=sizes)
        return rounded(box_statistics(runs, ["rule_name"], measure, method))

    return run


QUERIES["box_statistics"] = _boxes("MemEfficiencyPercent", "hazen")
QUERIES["box_statistics_linear"] = _boxes("ElapsedRaw", "linear")
QUERIES["box_statistics_sized"] = _boxes("UsedRAMPerMo", "hazen", sized=True)


@query("box_statistics_events")
def box_statistics_events(spark, sf_dir):
    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    return rounded(box_statistics(events, ["event_type"], "value", "linear"))


@query("box_points")
def box_points_of_runs(spark, sf_dir):
    runs = rules.rule_runs(star_tables.accounting(spark, sf_dir))
    return rounded(box_points(runs, ["rule_name"], "MemEfficiencyPercent"))


@query("box_points_events")
def box_points_events(spark, sf_dir):
    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    return rounded(box_points(events, ["event_type"], "value"))


# Workflow logs


@query("log_records")
def log_records_of_lines(spark, sf_dir):
    records = log_records(_lines(spark, sf_dir))
    return records.selectExpr("file", "first_line", "slurm_jobid", "job_id", "rule_name", "array_join(inputs, ',') AS inputs")


@query("log_input_sizes")
def _log_sizes(spark, sf_dir):
    return log_input_sizes(_lines(spark, sf_dir), star_tables.manifest(spark, sf_dir))


@query("log_run_ids")
def log_run_ids(spark, sf_dir):
    return run_ids(_lines(spark, sf_dir))


@query("input_sizes_csv")
def input_sizes_csv(spark, sf_dir):
    path = scratch_path(spark, "input-sizes")
    dumps.write_input_sizes(_log_sizes(spark, sf_dir), path)
    return dumps.read_input_sizes(spark, path)


@query("post_run_statistics")
def post_run_statistics(spark, sf_dir):
    report = rules.report_of_lines(
        _lines(spark, sf_dir), star_tables.accounting(spark, sf_dir), star_tables.manifest(spark, sf_dir)
    )
    return _statistics(report)


# Ingest and storage


@query("sanitized_lines")
def sanitized_lines(spark, sf_dir):
    return lines.whole_lines(star_tables.dump_lines(spark, sf_dir), column_count=4)


@query("sanitizer_counts")
def sanitizer_counts(spark, sf_dir):
    return lines.line_counts(star_tables.dump_lines(spark, sf_dir), column_count=4)


@query("ingested_dump")
def ingested_dump(spark, sf_dir):
    folder, database = scratch_path(spark, "dump"), scratch_path(spark, "database")
    star_tables.dump_lines(spark, sf_dir).write.text(folder)
    ingest.ingest(spark, folder, database, DAY, column_count=4, names=star_tables.DUMP_COLUMNS)
    return rounded(store.read_day(spark, database, DAY))


@query("streamed_dump")
def streamed_dump(spark, sf_dir):
    folder = os.path.join(scratch_path(spark, "drop"), DAY)
    database, checkpoint = scratch_path(spark, "database"), scratch_path(spark, "progress")
    star_tables.dump_lines(spark, sf_dir).write.text(folder)
    ingest_new_dumps(spark, folder, database, checkpoint, names=star_tables.DUMP_COLUMNS).awaitTermination()
    return rounded(store.read_days(spark, database))


@query("redelivered_dump")
def redelivered_dump(spark, sf_dir):
    """A dump and, later, the same lines under another name."""
    folder = os.path.join(scratch_path(spark, "drop"), DAY)
    database, checkpoint = scratch_path(spark, "database"), scratch_path(spark, "progress")
    for _ in range(2):
        star_tables.dump_lines(spark, sf_dir).write.mode("append").text(folder)
        ingest_new_dumps(spark, folder, database, checkpoint, names=star_tables.DUMP_COLUMNS, once_within="30 days").awaitTermination()
    return rounded(store.read_days(spark, database))


def _layouts(spark, sf_dir):
    """Three layouts: two dumps, and rows that another tool had stored with narrower numbers. Bad lines are kept apart."""
    found = star_tables.layout_lines(spark, sf_dir)
    database, rejects = scratch_path(spark, "database"), scratch_path(spark, "rejects")
    for era, day in ((0, DAY), (1, oracles.NEXT_DAY)):
        folder, names = scratch_path(spark, "dump"), star_tables.LAYOUTS[era]
        found.where(f"era = {era}").select("value").write.text(folder)
        ingest.ingest(spark, folder, database, day, column_count=len(names), names=names, rejects=rejects)
    names = star_tables.LAYOUTS[2]
    good = found.where("era = 2").select("value").where(lines.rejection(names) + " IS NULL")
    typed = lines.typed_fields(good, names).withColumns({"ElapsedRaw": F.col("ElapsedRaw").cast("int"), "dt": F.lit(oracles.THIRD_DAY).cast("date")})
    store.write_rows(typed, database, dump="other-tool")
    return database, rejects


@query("layout_history")
def layout_history(spark, sf_dir):
    return rounded(store.read_days(spark, _layouts(spark, sf_dir)[0]))


@query("rejected_lines")
def rejected_lines(spark, sf_dir):
    rejects = store.read_days(spark, _layouts(spark, sf_dir)[1])
    return rounded(rejects.groupBy("dt", "reason").agg(F.count("value").alias("lines")))


@query("batch_and_stream")
def batch_and_stream(spark, sf_dir):
    """One half of the lines by batch, the other as a stream, into one database."""
    lines_, database = star_tables.dump_lines(spark, sf_dir), scratch_path(spark, "database")
    half, drop = scratch_path(spark, "dump"), os.path.join(scratch_path(spark, "drop"), oracles.NEXT_DAY)
    lines_.where("pmod(length(value), 2) = 0").write.text(half)
    lines_.where("pmod(length(value), 2) = 1").write.text(drop)
    ingest.ingest(spark, half, database, DAY, column_count=4, names=star_tables.DUMP_COLUMNS)
    ingest_new_dumps(spark, drop, database, scratch_path(spark, "progress"), names=star_tables.DUMP_COLUMNS).awaitTermination()
    return rounded(store.read_days(spark, database))


@query("database_files")
def database_files(spark, sf_dir):
    database = scratch_path(spark, "database")
    store.write_rows(star_tables.accounting_by_day(spark, sf_dir), database)
    found = store.read_files(spark, f"{database}/dt=1997-*/*/*.parquet", f"{database}/dt=1998-01-01")
    return rounded(found.select("JobID", "State", "dt"))


@query("job_export")
def job_export(spark, sf_dir):
    parquet, csv = scratch_path(spark, "jobs"), scratch_path(spark, "jobs-csv")
    jobs.efficiency_per_job(star_tables.accounting(spark, sf_dir), parquet=parquet, csv=csv)
    exported = spark.read.parquet(parquet)
    return rounded(spark.read.schema(exported.schema).options(header=True, **store.FAITHFUL).csv(csv))


@query("database_day")
def database_day(spark, sf_dir):
    database = scratch_path(spark, "database")
    store.write_rows(star_tables.accounting_by_day(spark, sf_dir), database)
    return store.read_day(spark, database, DAY).select("JobID", "ElapsedRaw", "MaxRSS")


@query("delimited_scan")
def delimited_scan(spark, sf_dir):
    path = scratch_path(spark, "delimited")
    rows = per_job.conform(star_tables.accounting(spark, sf_dir))
    rows.write.option("sep", "|").option("header", True).option("quote", "").csv(path)
    return dumps.read_delimited(spark, path).select(*oracles.ROW_COLUMNS)


@query("stored_rule_statistics")
def stored_rule_statistics(spark, sf_dir):
    report = rules.rule_efficiency(
        star_tables.accounting(spark, sf_dir), sizes=star_tables.input_sizes(spark, sf_dir), output=scratch_path(spark, "runs")
    )
    return _statistics(report)


# Log lines in runs that begin with a record, each written by one task.
RUNS = "(line_no - 10) div 60000"


def _partitions(spark):
    """As many as shuffles have: runs compress so well that partitions joined by their compressed size would be huge."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("log_files")
def log_files(spark, sf_dir):
    path = scratch_path(spark, "logs")
    ordered = star_tables.log_lines(spark, sf_dir).repartition(_partitions(spark), "file", F.expr(RUNS)).sortWithinPartitions("file", "line_no")
    ordered.select("file", "value").write.partitionBy("file").text(path)
    found = log_records(read_log_lines(spark, path))
    return found.selectExpr("slurm_jobid", "job_id", "rule_name", "array_join(inputs, ',') AS inputs")


def _write_logs(spark, sf_dir):
    """The logs as files below a folder per project, in the order of their lines."""
    root = scratch_path(spark, "projects")
    found = star_tables.log_lines(spark, sf_dir)
    for project in oracles.PROJECTS:
        own = found.where(F.col("file") == f"/w/{project}/.snakemake/log/run.log")
        own.repartition(_partitions(spark), F.expr(RUNS)).sortWithinPartitions("line_no").select("value").write.text(f"{root}/{project}/.snakemake/log")
    return root


def _write_growing(spark, sf_dir, folder, whole):
    """One file for every thousand records, or the beginnings of these files, under names that stay the same."""
    place, folders = scratch_path(spark, "parts"), Folders(spark, folder)
    found = star_tables.log_lines(spark, sf_dir).selectExpr("concat(substr(file, 4, 2), '-', (line_no - 10) div 6000) AS log", "line_no", "value")
    if not whole:
        found = found.where("(line_no - 10) % 6000 < 2000 + hash(log) % 1500")
    found.repartition(_partitions(spark), "log").sortWithinPartitions("log", "line_no").select("log", "value").write.partitionBy("log").text(place)
    for name in folders.names(place):
        for part in folders.names(f"{place}/{name}"):
            if part.startswith("part-"):
                target = f"{folder}/{name.removeprefix('log=')}.log"
                folders.delete(target)
                folders.move(f"{place}/{name}/{part}", target)


@query("growing_logs")
def growing_logs(spark, sf_dir):
    """Logs that are read when they are about half written, and again when they are complete."""
    folder, records, progress = (scratch_path(spark, n) for n in ("logs", "records", "progress"))
    for whole in (False, True):
        _write_growing(spark, sf_dir, folder, whole)
        found = extract_new_records(spark, folder, records, progress, final=whole)
    return found.selectExpr("slurm_jobid", "job_id", "rule_name", "array_join(inputs, ',') AS inputs")


@query("file_sizes")
def file_sizes(spark, sf_dir):
    root = _write_logs(spark, sf_dir)
    found = file_manifest(spark, [f"{root}/{p}/.snakemake/log" for p in oracles.PROJECTS]).where("path LIKE '%.txt'")
    project = F.regexp_extract("path", r"/(p\d+)/\.snakemake/", 1)
    return found.groupBy(project.alias("project")).agg(F.sum("length").alias("length"))


@query("post_run_files")
def post_run_files(spark, sf_dir):
    root = _write_logs(spark, sf_dir)
    sizes = star_tables.manifest(spark, sf_dir).withColumn("path", F.replace("path", F.lit("/w/"), F.lit(f"{plain_folder(root)}/")))
    logs = [f"{root}/{p}/.snakemake/log" for p in oracles.PROJECTS]
    return _statistics(rules.post_run_report(spark, logs, star_tables.accounting(spark, sf_dir), sizes))


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """What share of the requested memory and CPU time did each job use?"""
    return job_efficiency(spark, sf_dir)


# The operators for training text are an optional part: without their folder everything above still works.
LLM_SQL: dict[str, str] = {}
if importlib.util.find_spec("jobledger.llm") and importlib.util.find_spec("corpus_pipeline"):
    import corpus_pipeline
    from jobledger.llm import queries as llm_queries
    from jobledger.llm import sql as llm_sql

    QUERIES.update(llm_queries.queries())
    QUERIES["pipeline"] = corpus_pipeline.run
    LLM_SQL.update(llm_sql.oracle_sql())
    if corpus_pipeline.ORACLE_SQL:
        LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | LLM_SQL
