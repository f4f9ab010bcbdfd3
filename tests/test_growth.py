"""What grows day by day: the state of jobs, counts for medians, sums over days, logs."""

import datetime as dt
import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from jobledger.operators import timecols
from jobledger.operators.job_state import KEY, job_state, jobs_of_state, merged
from jobledger.operators.logs import log_records
from jobledger.operators.per_job import job_efficiency
from jobledger.plans import daily
from jobledger.plans import job_state as state_plans
from jobledger.plans.logs import extract_new_records
from jobledger.sources.workflow_logs import read_log_lines
from test_logs import written


def history(accounting, spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        job = rng.randrange(60)
        suffix = rng.choice(["", "", ".batch", ".extern", ".0", ".1", "_3", "_12", "_3.0", "_[4-9]", ".x"])
        rows.append(
            {
                "JobID": rng.choice([f"{job}{suffix}", f"{job}{suffix}", f"{job}{suffix}", "nobody"]),
                "State": rng.choice([None, "COMPLETED", "FAILED"]),
                "QOS": rng.choice([None, "fast", "slow"]),
                "Comment": rng.choice([None, f"rule_{job}"]),
                "ElapsedRaw": rng.choice([None, rng.randrange(9999)]),
                "CPUTimeRAW": rng.randrange(99),
                "MaxRSS": rng.choice([None, "5M", "7G", "12K"]),
                "ReqMem": rng.choice([None, "8G"]),
                "TotalCPU": rng.choice([None, "00:10:00"]),
            }
        )
    days = [dt.date(2026, 2, 1 + rng.randrange(12)) for _ in rows]
    frame = accounting(*rows)
    numbered = frame.rdd.zipWithIndex().map(lambda x: (*x[0], days[x[1]]))
    schema = ", ".join(f"{c} {t}" for c, t in frame.dtypes) + ", dt date"
    return spark.createDataFrame(numbered, schema).persist()


def shown(jobs, columns):
    # Rows of one job, day and kind may tie; the order key does not tell them apart, so texts are compared where it does.
    return sorted((tuple(r) for r in jobs.select(*columns).collect()), key=repr)


NUMBERS = ["JobRoot", "ElapsedRaw", "CPUTimeRAW", "MaxRSS", "ReqMem", "MaxRSS_G"]


def distinct_places(rows):
    """One row for each place in dump order, so that the first text is unique."""
    return rows.dropDuplicates(["JobID", "dt"])


@pytest.mark.parametrize("parts", [1, 3, 12])
def test_any_split_of_the_days_gives_the_roll_up(spark, accounting, tmp_path, parts):
    rows = distinct_places(history(accounting, spark)).where("JobID <> 'nobody'").persist()
    table = f"state_{uuid.uuid4().hex}"
    for part in random.Random(parts).sample(range(parts), parts):
        state_plans.merge_days(spark, rows.where(f"day(dt) % {parts} = {part}"), table, str(tmp_path), buckets=4)
    columns = [c for c in job_efficiency(rows).columns if c != "dt"]
    assert shown(state_plans.merged_jobs(spark, table), columns) == shown(job_efficiency(rows), columns)
    # Days that are merged again change nothing.
    state_plans.merge_days(spark, rows.where("day(dt) < 4"), table, str(tmp_path), buckets=4)
    assert shown(state_plans.merged_jobs(spark, table), columns) == shown(job_efficiency(rows), columns)


def test_rows_without_a_job_number_are_one_job(spark, accounting):
    rows = history(accounting, spark)
    state = merged(job_state(rows.where("day(dt) <= 6")), job_state(rows.where("day(dt) > 6")))
    assert shown(jobs_of_state(state), NUMBERS) == shown(job_efficiency(rows), NUMBERS)


def test_the_history_is_not_shuffled(spark, accounting, tmp_path):
    rows, table = history(accounting, spark), f"state_{uuid.uuid4().hex}"
    state_plans.merge_days(spark, rows, table, str(tmp_path), buckets=4)
    plan = state_plans.merge_plan(spark, rows.where("day(dt) = 1"), table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    left = plan[plan.index("SortMergeJoin") :].split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    below = [line for line in left[1:]]
    history_side = below[: next(i for i, line in enumerate(below) if "Exchange" in line)]
    assert any(f"{table}" in line and "FileScan" in line for line in history_side) and depth(below[0]) > 0
    # The finished jobs need no shuffle at all.
    assert "Exchange" not in state_plans.merged_jobs(spark, table)._jdf.queryExecution().executedPlan().toString()


def test_an_interrupted_replacement_is_ended(spark, accounting, tmp_path):
    rows, table = distinct_places(history(accounting, spark)).where("JobID <> 'nobody'"), f"state_{uuid.uuid4().hex}"
    state_plans.merge_days(spark, rows.where("day(dt) < 6"), table, str(tmp_path), buckets=4)
    state = state_plans.merge_plan(spark, rows.where("day(dt) >= 6"), table)
    state.write.option("path", str(tmp_path / "new")).bucketBy(4, KEY).sortBy(KEY).saveAsTable(f"{table}__next")
    spark.sql(f"DROP TABLE {table}")  # here the driver was lost
    state_plans.recover(spark, table)
    assert shown(state_plans.merged_jobs(spark, table), NUMBERS) == shown(job_efficiency(rows), NUMBERS)


# Medians from counts


TIMED = "JobID string, QOS string, Submit string, Start string, End string, State string, TotalCPU string, MaxRSS string, ReqMem string, ElapsedRaw long, CPUTimeRAW long, dt date"


def timed(spark, n=300):
    rng = random.Random(4)
    out = []
    for i in range(n):
        submit = dt.datetime(2026, 1, 28) + dt.timedelta(seconds=rng.randrange(40 * 86400))
        start = submit + dt.timedelta(seconds=rng.randrange(500))
        end = start + dt.timedelta(seconds=rng.randrange(20000))
        stamp = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S")
        out.append((str(i), rng.choice(["fast", "slow", None]), stamp(submit), stamp(start), stamp(end) if i % 9 else "Unknown", "COMPLETED", "00:01:00", "1G", "2G", 5, 5, submit.date()))
    return out, spark.createDataFrame(out, TIMED)


@pytest.mark.parametrize("period", [None, "week", "month"])
def test_medians_from_stored_counts_equal_medians_of_rows(spark, tmp_path, period):
    data, rows = timed(spark)
    path, first, last = str(tmp_path), dt.date(2026, 2, 1), dt.date(2026, 2, 24)
    daily.store_time_counts(rows, path)
    daily.store_time_counts(rows.where("dt = DATE'2026-02-10'"), path)  # a day is replaced
    found = daily.range_medians(spark, path, first, last, period)
    seconds = lambda a, b: int((dt.datetime.fromisoformat(b) - dt.datetime.fromisoformat(a)).total_seconds())
    begin = {None: lambda d: None, "week": lambda d: d - dt.timedelta(days=d.weekday()), "month": lambda d: d.replace(day=1)}[period]
    want = {}
    for _, qos, submit, start, end, *_, day in data:
        if first <= day <= last:
            for line in (("qos", qos), ("global", None)):
                group = want.setdefault((begin(day), *line), ([], []))
                group[0].append(seconds(submit, start))
                if end != "Unknown":
                    group[1].append(seconds(start, end))
    got = {(r["period"], r["scope"], r["QOS"]): (r["wait_median"], r["duration_median"]) for r in found.collect()}
    assert got == {k: (statistics.median(w), statistics.median(d) if d else None) for k, (w, d) in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "JobID" not in plan


# Hours of all days


def test_sums_over_days_equal_the_days_of_each_job(spark):
    rng = random.Random(7)
    data = []
    for i in range(300):
        start = dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.randrange(90 * 86400))
        length = 86400 * 3650 if i == 5 else rng.choice([0, 30, 86400, 3600, 200_000, 90_000])
        if i % 11 == 0:
            start = start.replace(hour=0, minute=0, second=0)
        end = start + dt.timedelta(seconds=length if i % 17 else -rng.randrange(200_000))
        data.append((start.strftime("%Y-%m-%dT%H:%M:%S") if i % 13 else "Unknown", end.strftime("%Y-%m-%dT%H:%M:%S") if i % 19 else None))
    frame = spark.createDataFrame(data, "Start string, End string").withColumn("Submit", F.col("Start"))
    one_by_one = timecols.daily_durations(frame).groupBy("date").agg(F.count("*").alias("jobs"), F.sum("daily_duration_hours").alias("hours"))
    want = {r["date"]: (r["jobs"], round(r["hours"], 6)) for r in one_by_one.collect()}
    assert {r["date"]: (r["jobs"], round(r["hours"], 6)) for r in timecols.daily_totals(frame).collect()} == want
    assert len(want) > 3650


def test_sums_over_days_shuffle_days_not_jobs(spark):
    """Two hundred thousand jobs of ten years: what is exchanged is bounded by days and partitions."""
    jobs = spark.range(200_000).selectExpr(
        "date_format(timestamp_seconds(1500000000 + id % 1000 * 86400), \"yyyy-MM-dd'T'HH:mm:ss\") AS Start",
        "date_format(timestamp_seconds(1500000000 + id % 1000 * 86400 + 315360000), \"yyyy-MM-dd'T'HH:mm:ss\") AS End",
        "CAST(NULL AS string) AS Submit",
    )
    found = timecols.daily_totals(jobs.repartition(4))
    assert found.count() == 4650 and found.agg(F.max("jobs")).first()[0] == 200_000


# Logs that grow


def records_of(rows):
    return sorted((r["file"].rpartition("/")[2], r["first_line"], r["slurm_jobid"], r["job_id"], r["rule_name"], tuple(r["inputs"])) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_any_cut_of_a_log_gives_the_records_of_one_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    logs = {f"{i}.log": written(rng, 25)[0] + "\n" for i in range(3)}
    folder, records, progress = tmp_path / "logs", str(tmp_path / "records"), str(tmp_path / "progress")
    folder.mkdir()
    for name, text in logs.items():
        (folder / name).write_text(text)
    (tmp_path / "whole").mkdir()
    want = extract_new_records(spark, str(folder), str(tmp_path / "whole" / "r"), str(tmp_path / "whole" / "p"), final=True).collect()
    plain = [r for r in log_records(read_log_lines(spark, str(folder))).collect()]
    assert len(want) == len(plain) > 20
    cuts = sorted(rng.randrange(len(logs["0.log"])) for _ in range(3))
    for cut in [*cuts, 1 << 30]:
        for name, text in logs.items():
            # One log comes late, one is complete early.
            (folder / name).write_text(text[: {"0.log": cut, "1.log": max(0, cut - 900), "2.log": cut * 2}[name]])
        found = extract_new_records(spark, str(folder), records, progress, final=cut == 1 << 30)
    assert records_of(found.collect()) == records_of(want)


def test_logs_that_have_not_changed_are_not_opened(spark, tmp_path, monkeypatch):
    from jobledger.plans import logs as plans

    folder, records, progress = tmp_path / "logs", str(tmp_path / "records"), str(tmp_path / "progress")
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.log").write_text(written(random.Random(i), 5)[0] + "\n")
    extract_new_records(spark, str(folder), records, progress)
    opened = []
    monkeypatch.setattr(plans, "read_log_lines", lambda s, paths: opened.append(paths) or read_log_lines(s, paths))
    before = extract_new_records(spark, str(folder), records, progress).count()
    assert opened == []
    with open(folder / "1.log", "a") as log:
        log.write("[Tue]\nrule new:\nJob 1 has been submitted with SLURM jobid 7 (log: a).\n")
    extract_new_records(spark, str(folder), records, progress)
    assert opened and all([p.rpartition("/")[2] for p in paths] == ["1.log"] for paths in opened)
    assert extract_new_records(spark, str(folder), records, progress, final=True).count() > before
