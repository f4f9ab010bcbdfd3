import datetime as dt
import json
import statistics

import pytest
from pyspark.sql import functions as F

from jobledger.operators.calendar import calendar, calendar_summary
from jobledger.operators.daily import merged_scopes
from jobledger.plans.daily import daily_metrics, daily_metrics_range, daily_report
from jobledger.schema import DAILY_METRICS
from jobledger.sources.metrics import day_documents, read_metrics, read_metrics_json, write_metrics, write_metrics_json
from jobledger.sources.store import MissingDay, write_days

DAY = "2026-02-24"


def job(number, qos, state, submit, start, end, cpu="00:10:00", rss="1G", elapsed=100):
    return [
        {"JobID": str(number), "QOS": qos, "State": state, "Submit": submit, "Start": start, "End": end, "TotalCPU": cpu, "ElapsedRaw": elapsed, "ReqMem": "2G", "CPUTimeRAW": 1000},
        {"JobID": f"{number}.0", "MaxRSS": rss},
    ]


ROWS = [
    *job(1, "fast", "COMPLETED", f"{DAY}T08:00:00", f"{DAY}T08:00:10", f"{DAY}T09:00:10"),
    *job(2, "fast", "FAILED", f"{DAY}T08:00:00", f"{DAY}T08:00:30", f"{DAY}T08:00:40"),
    *job(3, "slow", "PREEMPTED", "2026-02-23T08:00:00", f"{DAY}T08:00:00", "2026-02-25T08:00:00"),
    *job(4, "slow", "RUNNING", f"{DAY}T08:00:00", "Unknown", "Unknown", rss=None),
    *job(5, None, "COMPLETED", "2026-02-23T08:00:00", "2026-02-23T08:00:05", f"{DAY}T08:00:00"),
    *job(6, "global", "COMPLETED", f"{DAY}T08:00:00", f"{DAY}T08:00:01", f"{DAY}T08:00:02"),
]


@pytest.fixture
def metrics(accounting):
    return daily_metrics(accounting(*ROWS), DAY, {"cpu_seconds": 36000, "gb_seconds": 1000})


def lines(df):
    return {(r["scope"], r["QOS"]): r for r in df.collect()}


def test_metrics_of_a_day(metrics):
    got = lines(metrics)
    assert set(got) == {("global", None), ("qos", "fast"), ("qos", "slow"), ("qos", None), ("qos", "global")}
    fast, slow, whole = got["qos", "fast"], got["qos", "slow"], got["global", None]
    assert (fast["cpu_seconds"], fast["cpu_hours"], fast["gb_seconds"]) == (1200, pytest.approx(1 / 3), 200.0)
    assert fast["cpu_usage_percent"] == pytest.approx(1200 / 360) and fast["ram_usage_percent"] == pytest.approx(20)
    assert (fast["wait_mean"], fast["wait_median"], fast["wait_min"], fast["wait_max"]) == (20, 20, 10, 30)
    assert (fast["jobs_submitted"], fast["jobs_started"], fast["jobs_ended"], fast["jobs_ended_on_day"]) == (2, 2, 2, 2)
    assert (fast["jobs_completed"], fast["jobs_failed"], fast["jobs_preempted"]) == (1, 1, 0)
    # A job without a start has no waiting time; the job that ends tomorrow counts as ended because it started today.
    assert (slow["wait_mean"], slow["jobs_submitted"], slow["jobs_started"], slow["jobs_ended"], slow["jobs_ended_on_day"]) == (86400, 1, 1, 1, 0)
    assert slow["gb_seconds"] == 100.0
    durations = [3600, 10, 24 * 3600, 86395, 1]
    assert (whole["duration_mean"], whole["duration_median"]) == (statistics.mean(durations), statistics.median(durations))
    assert (whole["duration_min"], whole["duration_max"]) == (1, 86400)
    for name in ("cpu_seconds", "jobs_submitted", "jobs_started", "jobs_completed", "jobs_failed", "jobs_preempted"):
        assert whole[name] == sum(r[name] for (scope, _), r in got.items() if scope == "qos")


def test_days_at_once_equal_days_one_by_one(accounting):
    one = accounting(*ROWS).withColumn("dt", F.lit(dt.date(2026, 2, 24)))
    # The same job in the dump of the next day counts there again.
    two = accounting(*ROWS[:4], *job(9, "fast", "COMPLETED", "2026-02-25T01:00:00", "2026-02-25T02:00:00", "2026-02-25T03:00:00")).withColumn(
        "dt", F.lit(dt.date(2026, 2, 25))
    )
    together = daily_metrics_range(one.unionByName(two))
    for frame, day in ((one, "2026-02-24"), (two, "2026-02-25")):
        alone = lines(daily_metrics(frame.drop("dt"), day))
        assert lines(together.where(F.col("dt") == day)) == alone


def test_sums_of_nothing_are_zero(accounting):
    only = lines(daily_metrics(accounting({"JobID": "1", "QOS": "q"}), DAY))["global", None]
    assert (only["cpu_seconds"], only["gb_seconds"], only["wait_mean"], only["wait_median"], only["wait_min"]) == (0, 0.0, None, None, None)


def test_document_of_a_day(metrics):
    assert merged_scopes(metrics).where("name = 'global'").select("jobs_submitted").collect()[0][0] == 4
    document = json.loads(day_documents(metrics).collect()[0]["value"])
    assert set(document) == {"global", "fast", "slow", "null"}
    assert list(document["global"]) == list(DAILY_METRICS.values())
    assert document["global"]["Jobs soumis"] == 4 and document["null"]["Jobs terminés avec succès"] == 1
    assert document["slow"]["Durée médiane d'exécution (secondes)"] == 86400


def test_json_round_trip_and_flat_files(spark, metrics, tmp_path):
    write_metrics_json(metrics, str(tmp_path / "json"))
    stored = read_metrics_json(spark, str(tmp_path / "json"), DAY, DAY).collect()
    assert len(stored) == 1 and stored[0]["jobs_submitted"] == 4 and stored[0]["dt"] == dt.date(2026, 2, 24)
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "2026-02-01.json").write_text(json.dumps({"q": {"CPU.Heures": 1}, "global": {"CPU.Heures": 2.5}}, indent=2))
    (flat / "2026-02-02.json").write_text(json.dumps({"q": {"CPU.Heures": 1}}))
    (flat / "2026-03-01.json").write_text(json.dumps({"global": {"CPU.Heures": 9}}))
    rows = read_metrics_json(spark, str(flat), "2026-02-01", "2026-02-28").collect()
    assert [(r["dt"], r["cpu_hours"], r["cpu_seconds"]) for r in rows] == [(dt.date(2026, 2, 1), 2.5, None)]


def test_calendar(spark, metrics):
    series = calendar(metrics, "2026-02-22", "2026-02-25")
    rows = series.orderBy("dt").collect()
    assert [r["has_data"] for r in rows] == [False, False, True, False]
    assert [r["cpu_usage_percent"] for r in rows] == pytest.approx([0, 0, 10.0, 0])
    legend = {r["metric"]: r for r in calendar_summary(series).collect()}
    assert legend["cpu_usage_percent"]["days_with_data"] == 1 and legend["cpu_usage_percent"]["min_value"] == 0.0
    assert legend["ram_usage_percent"]["max_value"] == pytest.approx(50.0)
    with pytest.raises(ValueError):
        calendar(metrics, "2026-02-25", "2026-02-22")


def test_daily_report_replaces_its_day(spark, accounting, tmp_path):
    database, store = str(tmp_path / "db"), str(tmp_path / "metrics")
    one = accounting(*ROWS).withColumn("dt", F.lit(dt.date(2026, 2, 24)))
    write_days(one.unionByName(accounting(*ROWS[:2]).withColumn("dt", F.lit(dt.date(2026, 2, 25)))), database, many_days=True)
    daily_report(spark, database, "2026-02-25", store)
    for _ in range(2):
        daily_report(spark, database, DAY, store, json_path=str(tmp_path / "json"))
    stored = read_metrics(spark, store, DAY, "2026-02-25")
    assert stored.where("scope = 'global'").count() == 2 and stored.count() == 7
    with pytest.raises(MissingDay):
        daily_report(spark, database, "2026-02-26", store)


def test_rerun_of_one_day_keeps_the_others(spark, metrics, tmp_path):
    path = str(tmp_path / "m")
    write_metrics(metrics, path)
    write_metrics(metrics.withColumn("dt", F.lit(dt.date(2026, 2, 25))), path)
    write_metrics(metrics.where("scope = 'global'"), path)
    counts = {str(r["dt"]): r["count"] for r in spark.read.parquet(path).groupBy("dt").count().collect()}
    assert counts == {"2026-02-24": 1, "2026-02-25": 5}
