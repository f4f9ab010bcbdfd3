"""What reports read, and what they leave behind."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobledger.operators.quantiles import STEPS, quantiles_of_frequencies, values_to_rank
from jobledger.plans import daily, rules
from jobledger.sources import store
from jobledger.sources.metrics import read_metrics

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def held(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


@pytest.fixture
def database(accounting, tmp_path):
    rows = [{"JobID": f"{i}{s}", "JobName": f"run-{i % 4}" if s != ".0" else "other", "QOS": "q", "TotalCPU": "00:01:00", "MaxRSS": "1G", "ReqMem": "2G", "ElapsedRaw": 60, "CPUTimeRAW": 100, "Comment": "rule_a"} for i in range(1, 9) for s in ("", ".0")]
    path = str(tmp_path / "db")
    frame = accounting(*rows).withColumn("dt", F.date_add(F.lit(dt.date(2026, 2, 20)), F.substring("JobID", 1, 1).cast("int")))
    store.write_rows(frame, path)
    return path


def test_a_range_report_reads_its_days_and_no_medians(spark, database):
    names = ["cpu_usage_percent", "ram_usage_percent"]
    found = daily.daily_metrics_range(store.read_days(spark, database), "2026-02-22", "2026-02-24", names=names)
    assert found.columns == ["dt", "scope", "QOS", *names]
    shown = plan(found)
    assert "PartitionFilters: [isnotnull(dt" in shown and "Window" not in shown and "Join" not in shown
    whole = daily.daily_metrics_range(store.read_days(spark, database))
    want = whole.where("dt BETWEEN '2026-02-22' AND '2026-02-24'").select("dt", "scope", "QOS", *names)
    key = lambda r: (r["dt"], r["scope"])
    assert sorted(found.collect(), key=key) == sorted(want.collect(), key=key)


@pytest.mark.parametrize("by_frame", [False, True])
def test_named_runs_are_selected_before_the_roll_up(spark, accounting, tmp_path, by_frame):
    rows = [
        {"JobID": "1", "JobName": "run-1", "Comment": "rule_a"},
        {"JobID": "1.0", "JobName": "step", "MaxRSS": "1G"},
        {"JobID": "2", "JobName": "other", "Comment": "rule_a"},
        {"JobID": "2.0", "JobName": "run-1"},
        {"JobID": "3", "Comment": "rule_a"},
        {"JobID": "3.0", "JobName": "run-1"},
        {"JobID": "4", "JobName": "run-2", "Comment": "rule_a"},
    ]
    path = str(tmp_path / "rows")
    store.write_table(accounting(*rows), path)
    names = spark.createDataFrame([("run-1",)], "n string") if by_frame else ["run-1"]
    runs = rules.rule_runs(spark.read.parquet(path), names)
    # Job 2 has another name itself; job 3 has none and takes the step's. Steps with other names belong to their job.
    assert {r["JobRoot"]: r["MaxRSS"] for r in runs.collect()} == {"1": 2**30, "3": None}
    if not by_frame:
        assert "PushedFilters: [IsNotNull(JobName), StringContains(JobName,run-1)]" in plan(runs)


def test_stored_reports_hold_nothing(spark, database, tmp_path):
    before = held(spark)
    daily.daily_report(spark, database, "2026-02-21", str(tmp_path / "m"), json_path=str(tmp_path / "j"))
    assert held(spark) == before
    report = rules.rule_efficiency(store.read_days(spark, database))
    assert report.table("ElapsedRaw").count() == 1 and held(spark) > before
    report.close()
    assert held(spark) == before


def test_metrics_of_a_day_that_has_none_any_more(spark, database, tmp_path):
    path = str(tmp_path / "m")
    daily.daily_report(spark, database, "2026-02-21", path)
    from jobledger.sources.metrics import write_metrics

    write_metrics(read_metrics(spark, path, "2026-02-21", "2026-02-21").where("false"), path, "2026-02-21")
    assert read_metrics(spark, path, "2026-02-21", "2026-02-21").count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["daily_metrics", "daily_metrics_all_days", "metric_calendar", "cpu_table", "shown_cpu_table", "post_run_statistics", "stored_daily_report"])
def test_registered_queries_hold_nothing(spark, name):
    before = held(spark)
    assert entry.queries()[name](spark, SMALL).count() >= 0
    assert held(spark) == before


def test_crowded_values_do_not_meet_in_one_window(spark):
    """A million different values within a thousandth, in one group: exact, and every window sees few of them."""
    n = 1_000_000
    freq = spark.range(n).selectExpr("'g' AS k", "99.9D + id / 1e7 AS value", "1L AS n")
    found = quantiles_of_frequencies(freq, ["k"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    row = found.collect()[0]
    assert row["count"] == n
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert row[name] == pytest.approx(99.9 + p * (n - 1) / 1e7, abs=1e-12)
    wanted = " OR ".join(f"(before <= {r} AND {r} < before + n)" for r in (n // 4, n // 2, 3 * n // 4))
    # Half a million values may share a bucket; what is put in order is a 4096th of that for each of the ranks.
    assert 0 < values_to_rank(freq, ["k"], wanted).count() <= 3 * 2 * (n / 2 / STEPS + 1)
