"""What grows with the input: code the JVM can compile, rows made once, lines sorted once."""

import re

import __spark_entry__ as entry
from jobledger.operators import logs, rules
from jobledger.operators.job_state import job_state
from jobledger.operators.per_job import job_efficiency
from jobledger.plans import job_state as state_plans
from jobledger.plans.held import Held
from jobledger.sources import star_tables

# HotSpot interprets larger methods for ever.
COMPILED = 8000


def largest_method(df):
    code = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code.codegenString(df._jdf.queryExecution().executedPlan())))


def tables(spark, folder):
    spark.sql(
        """SELECT id AS o_orderkey, id % 7 AS o_custkey, 'F' AS o_orderstatus, CAST(id AS double) AS o_totalprice,
        TIMESTAMP_NTZ'1997-01-05 00:00:00' + INTERVAL '1' DAY * (id % 90) AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(1, 40)"""
    ).write.parquet(f"{folder}/orders.parquet")
    spark.sql(
        "SELECT id AS l_orderkey, 1 + CAST(n AS int) AS l_linenumber, CAST(n + id AS double) AS l_quantity FROM range(1, 40) CROSS JOIN (SELECT id AS n FROM range(7))"
    ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_roll_up_is_compiled(spark, tmp_path, accounting):
    accounting({"JobID": "1"}).write.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert largest_method(job_efficiency(spark.read.parquet(str(tmp_path / "rows")))) < COMPILED
        assert largest_method(entry.per_job_rows(spark, tables(spark, tmp_path))) < COMPILED
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_state_is_compiled(spark, tmp_path, accounting):
    accounting({"JobID": "1"}).write.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert largest_method(job_state(spark.read.parquet(str(tmp_path / "rows")))) < COMPILED
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_merges_read_rows_that_were_made_once(spark, tmp_path, monkeypatch):
    read, merge = [], state_plans.merge_days

    def recorded(spark, rows, *args, **options):
        read.extend(rows.inputFiles())
        merge(spark, rows, *args, **options)

    monkeypatch.setattr(entry.job_state, "merge_days", recorded)
    folder = tables(spark, tmp_path)
    assert entry.merged_job_state(spark, folder).count() == job_efficiency(star_tables.accounting(spark, folder)).count()
    assert read and not [file for file in read if "lineitem" in file or "orders" in file]


def test_records_across_parts(spark, monkeypatch):
    """Records of 1 to 30 lines, parts of 7 lines, chunks of 50: the same records as in one part; lines are sorted once."""
    rows, expected, n = [], [], 0
    for job in range(60):
        rows.append(("/w/.snakemake/log/a.log", n, "[now]"))
        first = n
        for extra in range(job % 30):
            rows.append(("/w/.snakemake/log/a.log", n + 1 + extra, "    input: old" if extra == 0 else "    input: x" if extra == 20 else "text"))
        n += 1 + job % 30
        rows.append(("/w/.snakemake/log/a.log", n, f"Job {job} has been submitted with SLURM jobid {job} (log: l)."))
        n += 1
        expected.append((first, str(job), ["x"] if job % 30 > 20 else ["old"] if job % 30 else []))
    lines = spark.createDataFrame(rows, "file string, line_no long, value string")
    monkeypatch.setattr(logs, "PART_LINES", 7)
    records = logs.log_records(logs.add_chunks(lines, 50))
    got = sorted((r["first_line"], r["slurm_jobid"], r["inputs"]) for r in records.collect())
    assert got == sorted(expected)
    assert "SortAggregate" not in records._jdf.queryExecution().sparkPlan().toString()


def test_joined_rows_of_records_are_not_put_together_by_compressed_size(spark):
    """Rows of few bytes, of which adaptive execution would make one task: they are dealt by record to all tasks."""
    rows = [("/w/.snakemake/log/a.log", 3 * n + i, text) for n in range(20) for i, text in enumerate(("[now]", " input: a, b", f"Job {n} has been submitted with SLURM jobid {n} (log: l)."))]
    lines = logs.add_chunks(spark.createDataFrame(rows, "file string, line_no long, value string"))
    sizes = logs.log_input_sizes(lines, spark.createDataFrame([("/w/a", 2), ("/w/b", 3)], "path string, length long"))
    assert sorted((int(r["job_id"]), r["input_size_bytes"], r["inputs"]) for r in sizes.collect()) == [(n, 5, "/w/a,/w/b") for n in range(20)]
    assert sizes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_counted_values_are_kept(spark):
    """With ``keep`` the rows are counted once and values near a rank are found once; results stay the same."""
    runs = spark.range(1000).selectExpr("concat('r', id % 3) AS rule_name", "CAST(id % 77 AS double) AS a", "CAST(id AS double) / 3 AS b")
    with Held() as held:
        kept = rules.rule_statistics(runs, ["a", "b"], texts=False, keep=held.keep)
        assert len(held.frames) == 2
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rules.rule_statistics(runs, ["a", "b"], texts=False).collect()))


def test_a_text_and_its_place_are_one_buffer(spark, accounting):
    rows = accounting({"JobID": "1.0", "State": "late"}, {"JobID": "1"}, {"JobID": "1.batch", "State": "first"}, {"JobID": "1.0", "State": "also late"})
    jobs = job_efficiency(rows)
    assert [r["State"] for r in jobs.collect()] == ["first"]
    assert "min_by" not in jobs._jdf.queryExecution().analyzed().toString()
