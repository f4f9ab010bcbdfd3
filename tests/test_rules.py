import math
import statistics

import pytest

from jobledger.operators import filters
from jobledger.operators.rules import shown_table
from jobledger.plans.rules import rule_efficiency, rule_runs
from jobledger.schema import RULE_HEADING, RULE_TABLES

SIZES = "slurm_jobid string, job_id string, rule_name string, input_size_bytes long, inputs string"


def job(number, comment, rss, elapsed, name="run-a", **more):
    return {
        "JobID": str(number), "Comment": comment, "JobName": name, "ReqMem": "1G", "MaxRSS": rss, "ElapsedRaw": elapsed,
        "CPUTimeRAW": 1000, "TotalCPU": "00:01:40", **more,
    }


ROWS = [
    job(3, "rule_a_wildcards_s=3", "256M", 60, Elapsed="00:01:00", QOS="third", NodeList="n3"),
    job(20, "rule_a_wildcards_s=20", "512M", 180, Elapsed="1-00:00:00", QOS="last", Account="x20"),
    job(10, "rule_a", "1G", 120, Elapsed="23:00:00", Account="x10", name="other-run-b"),
    job(4, "rule_b", "128M", 6, Elapsed="00:00:06"),
    job(5, "no rule", "128M", 6),
    job(6, None, "128M", 6),
]


def test_statistics(accounting):
    report = rule_efficiency(accounting(*ROWS))
    got = {r["rule_name"]: r for r in report.statistics.collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    memory = [25.0, 50.0, 100.0]
    assert a["MemEfficiencyPercent_mean"] == pytest.approx(statistics.mean(memory))
    assert a["MemEfficiencyPercent_median"] == 50.0
    assert a["MemEfficiencyPercent_std"] == pytest.approx(statistics.stdev(memory))
    assert (a["MemEfficiencyPercent_min"], a["MemEfficiencyPercent_max"]) == (25.0, 100.0)
    assert (a["ElapsedRaw_median"], a["ElapsedRaw_min"], a["ElapsedRaw_max"]) == (120.0, 60, 180)
    # Texts compare as texts, and the first ones come from the lowest job number that has any.
    assert (a["Elapsed_min"], a["Elapsed_max"]) == ("00:01:00", "23:00:00")
    assert (a["QOS"], a["Account"], a["NodeList"]) == ("third", "x10", "n3")
    assert b["MemEfficiencyPercent_std"] is None and b["QOS"] is None
    assert [r["rule_name"] for r in report.rules().collect()] == ["b", "a"]
    report.close()


def test_nan_reaches_the_mean_but_not_the_extremes(accounting):
    rows = [job(1, "rule_a", "0K", 1, **{"ReqMem": "0K"}), job(2, "rule_a", "256M", 1), job(3, "rule_a", "512M", 1)]
    row = rule_efficiency(accounting(*rows)).statistics.collect()[0]
    assert math.isnan(row["MemEfficiencyPercent_mean"]) and math.isnan(row["MemEfficiencyPercent_std"])
    assert (row["MemEfficiencyPercent_min"], row["MemEfficiencyPercent_median"], row["MemEfficiencyPercent_max"]) == (25.0, 50.0, 50.0)


def test_tables(accounting):
    report = rule_efficiency(accounting(*ROWS))
    table = report.table("MemEfficiencyPercent")
    assert table.columns == [RULE_HEADING, *RULE_TABLES["MemEfficiencyPercent"]]
    assert [r[0] for r in table.collect()] == ["a", "b"]
    shown = shown_table(table).collect()[0]
    assert shown["Efficacité mémoire moyenne"] == 58.333
    assert (shown["Efficacité mémoire moyenne (couleur)"], shown["Efficacité mémoire maximum (couleur)"]) == ("#d4a500", "#008000")
    assert "Efficacité mémoire (écart-type) (couleur)" not in shown.asDict()
    assert not any("couleur" in c for c in shown_table(report.table("ElapsedRaw")).columns)


def test_sizes_join(spark, accounting, tmp_path):
    sizes = spark.createDataFrame(
        [("3", "1", "a", 2 * 2**20, "p"), ("20", "2", "a", 0, "p"), ("4", "3", "b", 2**20, "p"), ("4", "4", "b", 3 * 2**20, "q"), ("99", "5", "z", 5, "p")],
        SIZES,
    )
    runs = rule_runs(accounting(*ROWS), sizes=sizes)
    got = sorted((r["JobID"], r["job_id"], r["rule_name"], r["rule_name_1"], r["MinPerMo"], r["UsedRAMPerMo"]) for r in runs.collect() if r["slurm_jobid"])
    assert got == [("3", "1", "a", "a", 0.5, 512.0), ("4", "3", "b", "b", 0.1, 1024.0), ("4", "4", "b", "b", pytest.approx(0.1 / 3), pytest.approx(1024 / 3))]
    assert sorted(r["JobID"] for r in runs.collect()) == ["10", "20", "3", "4", "4"]
    report = rule_efficiency(accounting(*ROWS), sizes=sizes, output=str(tmp_path / "runs"))
    stats = {r["rule_name"]: r for r in report.statistics.collect()}
    assert stats["a"]["MinPerMo_mean"] == 0.5 and stats["a"]["MinPerMo_std"] is None and stats["b"]["UsedRAMPerMo_max"] == 1024.0
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 5
    assert report.boxes("UsedRAMPerMo").count() == 2 and report.points("UsedRAMPerMo").count() == 0


def test_names(spark, accounting):
    def ids(df):
        return sorted(r["JobID"] for r in df.collect())

    rows = accounting(*ROWS, job(7, "rule_a", "1G", 1, name="x%y_z"), job(8, "rule_a", "1G", 1, name=None))
    assert ids(filters.name_contains_any(rows, ["run-b", "%y_"])) == ["10", "7"]
    assert ids(filters.name_contains_any(rows, [])) == []
    assert ids(filters.name_contains_any(rows, None)) == ids(rows)
    assert ids(filters.name_is_any(rows, ["run-a"])) == ["20", "3", "4", "5", "6"]
    names = spark.createDataFrame([("run-a",), ("run-a",), ("other",)], "run_id string")
    assert ids(rule_runs(rows, names)) == ["20", "3", "4"]
    assert ids(rule_runs(rows, ["run-b"])) == ["10"]


def test_a_step_may_have_another_name_than_its_job(accounting):
    rows = accounting(job(1, "rule_a", "1G", 5), {"JobID": "1.0", "JobName": "hostname", "MaxRSS": "2G"})
    run = rule_runs(rows, ["run-a"]).collect()[0]
    assert run["MemEfficiencyPercent"] == 200.0
    assert rule_runs(rows, ["hostname"]).count() == 0


def test_size_table_is_not_forced_to_be_broadcast(spark, accounting):
    sizes = spark.createDataFrame([("3", "1", "a", 1, "p")], SIZES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = rule_runs(accounting(*ROWS), sizes=sizes)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
