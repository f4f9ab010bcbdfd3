import datetime as dt

import pytest

from jobledger.operators.lines import line_counts, whole_lines
from jobledger.plans.ingest import ingest
from jobledger.schema import ACCOUNTING_COLUMNS, ACCOUNTING_SCHEMA, INTEGER_COLUMNS
from jobledger.sources import dumps, store
from jobledger.streaming.ingest import ingest_new_dumps

DAY = "2026-02-24"


def line(**values):
    return "|".join(str(values.get(name, "")) for name in ACCOUNTING_COLUMNS)


HEADER = "|".join(ACCOUNTING_COLUMNS)
LINES = [
    line(JobID="1", ElapsedRaw=5, JobName='say "hi', State="COMPLETED"),
    line(JobID="2", State=" x "),
    "broken|line",
    line(JobID="3") + "|extra",
    "",
    line(JobID='"4'),
]


@pytest.fixture
def dump(tmp_path):
    path = tmp_path / f"{DAY}.csv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n")
    return str(path)


def test_sanitizer(spark, dump):
    lines = dumps.read_lines(spark, dump)
    assert whole_lines(lines).count() == 4
    assert tuple(line_counts(lines).collect()[0]) == (7, 4, 3)
    three = spark.createDataFrame([("a||b||c",), ("a||b",), ("a|b||c",)], "value string")
    assert [r[0] for r in whole_lines(three, 3, "||").collect()] == ["a||b||c"]


def test_ingest(spark, dump, tmp_path):
    database = str(tmp_path / "db")
    before = open(dump).read()
    result = ingest(spark, dump, database, DAY)
    assert (result.lines, result.dropped) == (7, 3)
    assert open(dump).read() == before
    rows = {r["JobID"]: r for r in store.read_day(spark, database, DAY).collect()}
    assert set(rows) == {"1", "2", '"4'}
    assert rows["1"]["ElapsedRaw"] == 5 and rows["1"]["JobName"] == 'say "hi' and rows["1"]["Account"] is None
    assert rows["2"]["State"] == " x " and rows["1"]["dt"] == dt.date(2026, 2, 24)
    ingest(spark, dump, database, "2026-02-25")
    ingest(spark, dump, database, DAY)
    assert store.read_days(spark, database).count() == 6
    types = dict(store.read_days(spark, database).dtypes)
    assert all(types[f.name] == f.dataType.simpleString() for f in ACCOUNTING_SCHEMA)
    plan = store.read_days(spark, database).where(f"dt = DATE'{DAY}'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_columns_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "d.csv"
    names = ACCOUNTING_COLUMNS[::-1]
    path.write_text("|".join(names) + "\n" + "|".join("7" if n in INTEGER_COLUMNS else n.lower() for n in names) + "\n")
    row = dumps.read_dump(spark, str(path)).collect()[0]
    assert row["Account"] == "account" and row["AllocCPUS"] == 7


def test_bad_numbers_and_headers_fail(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("\n".join([HEADER, line(JobID="1", ElapsedRaw="five")]) + "\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ingest(spark, str(bad), str(tmp_path / "db"), DAY)
    with pytest.raises(Exception, match="MALFORMED|MalformedRecord|NumberFormat|FAILED_READ_FILE"):
        dumps.read_delimited(spark, str(bad)).collect()
    short = tmp_path / "short.csv"
    short.write_text("a|b\n1|2\n")
    with pytest.raises(ValueError, match="2 columns"):
        ingest(spark, str(short), str(tmp_path / "db"), DAY)


def test_clean_delimited_file(spark, tmp_path):
    path = tmp_path / "clean.csv"
    path.write_text("\n".join([HEADER, LINES[0], LINES[1]]) + "\n")
    rows = {r["JobID"]: r for r in dumps.read_delimited(spark, str(path)).collect()}
    assert rows["1"]["JobName"] == 'say "hi' and rows["1"]["ElapsedRaw"] == 5 and rows["1"]["Account"] is None


def test_files_named_by_day(spark, accounting, tmp_path):
    accounting({"JobID": "1"}).toPandas().to_parquet(tmp_path / "2026-02-24.parquet")
    accounting({"JobID": "2"}).toPandas().to_parquet(tmp_path / "2026-02-25.parquet")
    (tmp_path / "2026-02-24.json").write_text("{}")
    for paths in ([str(tmp_path)], [f"{tmp_path}/2026-02-2*.parquet"], [f"{tmp_path}/2026-02-24.parquet", f"{tmp_path}/2026-02-25.parquet"]):
        rows = store.read_files(spark, *paths)
        assert sorted((r["JobID"], str(r["dt"])) for r in rows.collect()) == [("1", "2026-02-24"), ("2", "2026-02-25")]


def test_a_day_of_flat_files(spark, accounting, tmp_path):
    for name, job in (("2026-02-24", "1"), ("2026-02-25", "2")):
        accounting({"JobID": job}).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    (tmp_path / "2026-02-24.json").write_text("{}")
    rows = store.read_day(spark, str(tmp_path), DAY)
    assert [(r["JobID"], r["dt"]) for r in rows.collect()] == [("1", dt.date(2026, 2, 24))]
    assert rows.rdd.getNumPartitions() == 1
    with pytest.raises(store.MissingDay):
        store.read_day(spark, str(tmp_path), "2026-02-26")


def test_jobs_by_name_over_all_days(spark, accounting, tmp_path):
    from pyspark.sql import functions as F

    rows = accounting({"JobID": "1", "JobName": "a"}, {"JobID": "2", "JobName": "ab"}).withColumn("dt", F.lit(dt.date(2026, 2, 24)))
    store.write_days(rows, str(tmp_path / "db"))
    named = store.read_jobs_named(spark, str(tmp_path / "db"), ["a"])
    assert [r["JobID"] for r in named.collect()] == ["1"]
    assert "PushedFilters: [IsNotNull(JobName), EqualTo(JobName,a)]" in named._jdf.queryExecution().executedPlan().toString()


def test_stream_ingests_each_dump_once(spark, tmp_path):
    drop, database, progress = tmp_path / "drop", str(tmp_path / "db"), str(tmp_path / "progress")
    drop.mkdir()

    def run():
        ingest_new_dumps(spark, str(drop), database, progress).awaitTermination()
        return sorted((r["JobID"], str(r["dt"])) for r in store.read_days(spark, database).collect())

    (drop / "2026-02-24.csv").write_text("\n".join([HEADER, *LINES]) + "\n")
    first = [('"4', "2026-02-24"), ("1", "2026-02-24"), ("2", "2026-02-24")]
    assert run() == first
    assert run() == first
    (drop / "2026-02-25.csv").write_text("\n".join([HEADER, LINES[0]]) + "\n")
    assert run() == sorted(first + [("1", "2026-02-25")])


def stored(spark, database):
    return sorted((r["JobID"], str(r["dt"])) for r in store.read_days(spark, database).collect())


@pytest.mark.parametrize("first", ["batch", "stream"])
def test_batch_and_stream_share_a_database(spark, tmp_path, first):
    drop, database, progress = tmp_path / "drop", str(tmp_path / "db"), str(tmp_path / "progress")
    drop.mkdir()
    (drop / "2026-02-25.csv").write_text("\n".join([HEADER, line(JobID="s")]) + "\n")
    for day, job in (("2026-02-24", "b1"), ("2026-02-26", "b2")):
        (tmp_path / f"{day}.csv").write_text("\n".join([HEADER, line(JobID=job)]) + "\n")

    def stream():
        ingest_new_dumps(spark, str(drop), database, progress).awaitTermination()

    if first == "stream":
        stream()
    ingest(spark, str(tmp_path / "2026-02-24.csv"), database, "2026-02-24")
    if first == "batch":
        stream()
    ingest(spark, str(tmp_path / "2026-02-26.csv"), database, "2026-02-26")
    assert stored(spark, database) == [("b1", "2026-02-24"), ("b2", "2026-02-26"), ("s", "2026-02-25")]
    # Another dump of a streamed day stays beside it; the streamed dump itself is replaced by its batch rerun.
    (tmp_path / "more.csv").write_text("\n".join([HEADER, line(JobID="s2")]) + "\n")
    ingest(spark, str(tmp_path / "more.csv"), database, "2026-02-25")
    (drop / "2026-02-25.csv").write_text("\n".join([HEADER, line(JobID="s3")]) + "\n")
    ingest(spark, str(drop / "2026-02-25.csv"), database, "2026-02-25")
    assert stored(spark, database) == [("b1", "2026-02-24"), ("b2", "2026-02-26"), ("s2", "2026-02-25"), ("s3", "2026-02-25")]


def test_an_empty_rerun_clears_its_dump(spark, dump, tmp_path):
    database = str(tmp_path / "db")
    ingest(spark, dump, database, DAY)
    ingest(spark, dump, database, "2026-02-25")
    with open(dump, "w") as file:
        file.write(HEADER + "\nbroken|line\n")
    assert ingest(spark, dump, database, DAY).dropped == 1
    assert {d for _, d in stored(spark, database)} == {"2026-02-25"}
    with pytest.raises(store.MissingDay):
        store.read_day(spark, database, DAY)


def test_an_empty_streamed_dump_clears_what_a_batch_left(spark, dump, tmp_path):
    drop, database = tmp_path / "drop", str(tmp_path / "db")
    drop.mkdir()
    ingest(spark, dump, database, DAY)
    (drop / f"{DAY}.csv").write_text(HEADER + "\nbroken|line\n")
    ingest_new_dumps(spark, str(drop), database, str(tmp_path / "progress")).awaitTermination()
    assert stored(spark, database) == []


def test_each_file_is_read_with_its_own_header(spark, tmp_path):
    drop = tmp_path / DAY
    drop.mkdir()
    (drop / "a.csv").write_text(HEADER + "\n" + line(JobID="1", QOS="q", State="s") + "\n")
    swapped = ACCOUNTING_COLUMNS[::-1]
    (drop / "b.csv").write_text("|".join(swapped) + "\n" + "|".join({"JobID": "2", "QOS": "q", "State": "s"}.get(n, "") for n in swapped) + "\n")
    want = [("1", "q", "s"), ("2", "q", "s")]
    pick = lambda rows: sorted(map(tuple, rows.select("JobID", "QOS", "State").collect()))
    assert pick(dumps.read_dump(spark, str(drop))) == want
    ingest(spark, str(drop), str(tmp_path / "batch"), DAY)
    assert pick(store.read_days(spark, str(tmp_path / "batch"))) == want
    ingest_new_dumps(spark, str(drop), str(tmp_path / "stream"), str(tmp_path / "progress")).awaitTermination()
    assert pick(store.read_days(spark, str(tmp_path / "stream"))) == want


def test_unknown_headers_and_undated_dumps_fail(spark, tmp_path):
    for name, header, message in (("undated.csv", HEADER, "no day"), (f"{DAY}.csv", HEADER.replace("QOS", "Quality"), "other columns")):
        drop = tmp_path / name.replace(".", "_").replace(DAY, "other")
        drop.mkdir()
        (drop / name).write_text(header + "\n" + line(JobID="1") + "\n")
        with pytest.raises(Exception, match=message):
            ingest_new_dumps(spark, str(drop), str(tmp_path / "db"), str(tmp_path / f"p-{drop.name}")).awaitTermination()


def test_delimited_sizes_keep_spaces_quotes_and_empty_texts(spark, tmp_path):
    from jobledger.schema import INPUT_SIZE_SCHEMA

    rows = [("1", " padded ", "", 5, '/w/q"x|y'), ("2", None, None, None, " /w/a ")]
    frame = spark.createDataFrame(rows, INPUT_SIZE_SCHEMA)
    dumps.write_input_sizes(frame, str(tmp_path / "sizes"))
    assert sorted(map(tuple, dumps.read_input_sizes(spark, str(tmp_path / "sizes")).collect())) == rows
    (tmp_path / "other.csv").write_text('slurm_jobid|job_id|rule_name|input_size_bytes|inputs\n7|8||9|"/w/q""x|y"\n')
    assert [tuple(r) for r in dumps.read_input_sizes(spark, str(tmp_path / "other.csv")).collect()] == [("7", "8", None, 9, '/w/q"x|y')]


def test_per_job_export_keeps_spaces(spark, tmp_path):
    store.write_csv(spark.createDataFrame([(" padded ", 'a "b"', None)], "a string, b string, c string").coalesce(1), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text == 'a,b,c\n padded ,"a ""b""",\n'
