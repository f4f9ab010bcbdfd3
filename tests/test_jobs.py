import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from jobledger.operators import per_job
from jobledger.plans.jobs import efficiency_per_job
from jobledger.schema import ACCOUNTING_COLUMNS, ACCOUNTING_SCHEMA, INTEGER_COLUMNS, JOB_REPORT_COLUMNS, JOB_REPORT_DERIVED


def test_layout():
    assert len(ACCOUNTING_COLUMNS) == len(set(ACCOUNTING_COLUMNS)) == 109
    assert len(INTEGER_COLUMNS) == 27 and set(INTEGER_COLUMNS) <= set(ACCOUNTING_COLUMNS)
    assert len(JOB_REPORT_COLUMNS) == 61 and set(JOB_REPORT_COLUMNS) <= set(ACCOUNTING_COLUMNS)
    assert sum(f.dataType.simpleString() == "bigint" for f in ACCOUNTING_SCHEMA) == 27


def jobs_by_root(df):
    return {r["JobRoot"]: r for r in df.collect()}


def test_first_texts_follow_dump_order(accounting):
    rows = [
        {"JobID": "1.10", "Account": "ten"},
        {"JobID": "1.2", "Account": "two", "NodeList": "n2"},
        {"JobID": "1.extern", "State": "extern state"},
        {"JobID": "1.batch", "State": "batch state"},
        {"JobID": "1", "ElapsedRaw": 5},
        {"JobID": "1.weird", "Elapsed": "last", "NodeList": "nw"},
        {"JobID": "2_7", "State": "seven"},
        {"JobID": "2_11", "State": "eleven"},
        {"JobID": "x", "State": "no number"},
    ]
    for order in (rows, rows[::-1]):
        jobs = jobs_by_root(per_job.job_efficiency(accounting(*order).repartition(3)))
        assert set(jobs) == {"1", "2", None}
        one = jobs["1"]
        assert (one["JobID"], one["State"], one["Account"], one["NodeList"], one["Elapsed"]) == ("1", "batch state", "two", "n2", "last")
        assert one["JobInfoType"] == "allocation" and one["ElapsedRaw"] == 5 and one["QOS"] is None
        assert jobs["2"]["State"] == "seven"


def test_efficiency(accounting):
    jobs = jobs_by_root(
        per_job.job_efficiency(
            accounting(
                {"JobID": "1", "ReqMem": "2G", "CPUTimeRAW": 1000, "TotalCPU": "00:08:20"},
                {"JobID": "1.0", "MaxRSS": "512M"},
                {"JobID": "1.1", "MaxRSS": "1024M"},
                {"JobID": "2", "ReqMem": "0K", "MaxRSS": "0K", "CPUTimeRAW": 0, "TotalCPU": None},
                {"JobID": "3", "ReqMem": "0K", "MaxRSS": "1K", "CPUTimeRAW": 0, "TotalCPU": "00:00:01"},
                {"JobID": "4", "ReqMem": "1T", "MaxRSS": "1K"},
            )
        )
    )
    assert jobs["1"]["MemEfficiencyPercent"] == 50.0 and jobs["1"]["CPUEfficiencyPercent"] == 50.0
    assert jobs["1"]["MaxRSS"] == 2**30 and jobs["1"]["MaxRSS_G"] == 1.0 and jobs["1"]["ReqMem_G"] == 2.0
    assert math.isnan(jobs["2"]["MemEfficiencyPercent"]) and jobs["2"]["CPUEfficiencyPercent"] == 0.0
    assert jobs["3"]["MemEfficiencyPercent"] == math.inf and jobs["3"]["CPUEfficiencyPercent"] == math.inf
    assert jobs["4"]["MemEfficiencyPercent"] is None and jobs["4"]["CPUEfficiencyPercent"] is None


def test_job_in_two_days(accounting):
    def dump(day, **values):
        return accounting({"JobID": "1", **values}).withColumn("dt", F.lit(dt.date(2026, 1, day)))

    both = dump(2, State="COMPLETED", ElapsedRaw=20, Account="a").unionByName(dump(1, State="RUNNING", ElapsedRaw=10))
    by_day = per_job.job_efficiency(both, keys=["dt", "JobRoot"]).orderBy("dt").collect()
    assert [(r["State"], r["ElapsedRaw"]) for r in by_day] == [("RUNNING", 10), ("COMPLETED", 20)]
    for merge in (per_job.job_efficiency, lambda df: per_job.aggregate_per_job(per_job.add_job_kind(df))):
        merged = merge(both)
        assert "dt" not in merged.columns
        assert [(r["State"], r["ElapsedRaw"], r["Account"]) for r in merged.collect()] == [("RUNNING", 20, "a")]


def test_stepwise_sizes_equal_the_combined_form(accounting):
    rows = accounting({"JobID": "1", "MaxRSS": "5M", "ReqMem": "1.5G"}, {"JobID": "2", "MaxRSS": "x", "ReqMem": "3T"})
    steps = rows.transform(per_job.add_size_unit, "MaxRSS", "ReqMem").transform(per_job.size_to_bytes, "MaxRSS", "ReqMem")
    steps = per_job.bytes_to_gigabytes(steps, "ReqMem")
    got = {r["JobID"]: (r["MaxRSS"], r["ReqMem"]) for r in steps.collect()}
    assert got == {"1": (5 * 2**20, 5.0), "2": (None, None)}


def test_other_types_are_refused(accounting):
    with pytest.raises(TypeError, match="day"):
        per_job.aggregate_per_job(per_job.add_job_kind(accounting({"JobID": "1"})).withColumn("day", F.lit(dt.date(2026, 1, 1))))


def test_report_columns(spark, accounting, tmp_path):
    report = efficiency_per_job(accounting({"JobID": "1", "ReqMem": "1G"}), parquet=str(tmp_path / "p"), csv=str(tmp_path / "c"))
    assert report.columns == JOB_REPORT_COLUMNS + JOB_REPORT_DERIVED
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1


def test_unused_columns_and_their_aggregates_are_pruned(spark, accounting, tmp_path):
    accounting({"JobID": "1", "ReqMem": "1G"}).write.parquet(str(tmp_path / "rows"))
    plan = per_job.job_efficiency(spark.read.parquet(str(tmp_path / "rows"))).select("JobRoot", "CPUEfficiencyPercent")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<JobID:string,CPUTimeRAW:bigint,TotalCPU:string>" in text


def test_bucketed_rows_need_no_shuffle(spark, accounting, tmp_path):
    from jobledger.sources.store import save_bucketed

    rows = per_job.add_job_kind(accounting(*[{"JobID": f"{i}.{s}", "ElapsedRaw": s} for i in range(20) for s in range(3)]))
    save_bucketed(rows, "rows_by_job", str(tmp_path / "rows_by_job"), 4)
    try:
        jobs = per_job.aggregate_per_job(spark.table("rows_by_job")).select("JobRoot", "ElapsedRaw")
        assert "Exchange" not in jobs._jdf.queryExecution().executedPlan().toString()
        assert sorted((r[0], r[1]) for r in jobs.collect()) == sorted((str(i), 2) for i in range(20))
    finally:
        spark.sql("DROP TABLE rows_by_job")
