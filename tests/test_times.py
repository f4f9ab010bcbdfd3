import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobledger.operators import timecols

DAY = "2026-02-24"
# The usual cases of a job and a day, with the hours that fall on it.
CASES = [
    ("same day", "2026-02-24T10:00:00", "2026-02-24T14:00:00", 4.0),
    ("started previous day", "2026-02-23T22:00:00", "2026-02-24T02:00:00", 2.0),
    ("ends next day", "2026-02-24T20:00:00", "2026-02-25T04:00:00", 4.0),
    ("spanning", "2026-02-23T12:00:00", "2026-02-25T12:00:00", 24.0),
    ("past", "2026-02-22T10:00:00", "2026-02-22T14:00:00", 0.0),
    ("future", "2026-02-25T10:00:00", "2026-02-25T14:00:00", 0.0),
    ("midnight to midnight", "2026-02-24T00:00:00", "2026-02-25T00:00:00", 24.0),
    ("half hour", "2026-02-24T10:00:00", "2026-02-24T10:30:00", 0.5),
    ("still running", "2026-02-24T10:00:00", "Unknown", 0.0),
    ("never started", None, "2026-02-24T10:30:00", 0.0),
    ("backwards", "2026-02-24T10:00:00", "2026-02-24T09:00:00", -1.0),
    ("backwards over days", "2026-02-25T10:00:00", "2026-02-24T09:00:00", 0.0),
]


def frame(spark, cases):
    return spark.createDataFrame([(n, s, e) for n, s, e, _ in cases], "JobID string, Start string, End string")


@pytest.mark.parametrize("day", [DAY, dt.date(2026, 2, 24)])
def test_hours_on_a_day(spark, day):
    rows = timecols.add_daily_duration(frame(spark, CASES), day).collect()
    assert {r["JobID"]: r["daily_duration_hours"] for r in rows} == pytest.approx({n: h for n, _, _, h in CASES})
    assert {r["date"] for r in rows} == {dt.date(2026, 2, 24)}


def test_all_days_add_up_to_the_duration(spark):
    df = timecols.daily_durations(frame(spark, CASES))
    totals = {r["JobID"]: r["h"] for r in df.groupBy("JobID").agg(F.sum("daily_duration_hours").alias("h")).collect()}
    assert totals == pytest.approx(
        {"same day": 4, "started previous day": 4, "ends next day": 8, "spanning": 48, "past": 4, "future": 4,
         "midnight to midnight": 24, "half hour": 0.5, "backwards": -1}
    )
    on_day = {r["JobID"]: r["daily_duration_hours"] for r in df.where("date = '2026-02-24'").collect()}
    assert all(on_day.get(n, 0.0) == pytest.approx(h) for n, _, _, h in CASES)


def test_wait_and_duration(spark, accounting):
    df = accounting(
        {"JobID": "1", "Submit": "2026-02-24T09:00:00", "Start": "2026-02-24T10:30:00", "End": "2026-02-24T10:30:05"},
        {"JobID": "2", "Submit": "2026-02-24T09:00:00", "Start": "Unknown", "End": "Unknown"},
    )
    rows = timecols.add_job_duration(timecols.add_wait_time(df)).orderBy("JobID").collect()
    assert [(r["wait_time_seconds"], r["wait_time_hours"], r["job_duration_seconds"]) for r in rows] == [(5400, 1.5, 5), (None, None, None)]
