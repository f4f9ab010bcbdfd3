"""Safe replacement, layouts that change, rejected lines, look-ups by name, dumps delivered twice."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from jobledger.operators.lines import rejection
from jobledger.plans.ingest import ingest
from jobledger.schema import ACCOUNTING_COLUMNS
from jobledger.sources import dumps, layouts, metrics, publish, store
from jobledger.streaming.ingest import ingest_new_dumps

DAY, NEXT = "2026-02-24", "2026-02-25"


def jobs(spark, database, day=DAY):
    return sorted(r["JobID"] for r in store.read_day(spark, database, day).select("JobID").collect())


def rows(spark, *ids):
    return spark.createDataFrame([(i, 5) for i in ids], "JobID string, ElapsedRaw long")


# Safe replacement


class Killed(Exception):
    pass


def killed_at(monkeypatch, spark, step):
    """Lets a write die at a step: after staging, or between taking the old day away and bringing the new one."""
    if step == "staged":

        def finish(*_):
            raise Killed

        monkeypatch.setattr(publish, "finish", lambda s, root: [] if not publish.Folders(s, root).names(f"{root}/{publish.STAGING}") else finish())
        return
    move = publish.Folders.move

    def dying(self, source, target):
        if publish.READY + "/" in source and not source.endswith(publish.READY):
            raise Killed
        move(self, source, target)

    monkeypatch.setattr(publish.Folders, "move", dying)


def test_a_write_that_dies_before_publishing_leaves_the_old_day(spark, tmp_path, monkeypatch):
    database = str(tmp_path)
    store.write_dump(rows(spark, "1", "2"), database, DAY, "a")
    with monkeypatch.context() as patch:
        killed_at(patch, spark, "staged")
        with pytest.raises(Killed):
            store.write_dump(rows(spark, "3"), database, DAY, "a")
    assert jobs(spark, database) == ["1", "2"]
    # What was ready is published before the next write, which is another dump's.
    store.write_dump(rows(spark, "4"), database, NEXT, "b")
    assert jobs(spark, database) == ["3"] and jobs(spark, database, NEXT) == ["4"]


def test_a_write_that_dies_while_writing_leaves_the_old_day(spark, tmp_path):
    database = str(tmp_path)
    store.write_dump(rows(spark, "1"), database, DAY, "a")
    broken = rows(spark, "x").select(F.col("JobID").cast("long").cast("string").alias("JobID"), "ElapsedRaw")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        store.write_dump(broken, database, DAY, "a")
    store.write_dump(rows(spark, "2"), database, NEXT, "a")
    assert jobs(spark, database) == ["1"] and jobs(spark, database, NEXT) == ["2"]


def test_a_replacement_that_dies_half_way_is_finished(spark, tmp_path, monkeypatch):
    database = str(tmp_path)
    store.write_dump(rows(spark, "1"), database, DAY, "a")
    with monkeypatch.context() as patch:
        killed_at(patch, spark, "moving")
        with pytest.raises(Killed):
            store.write_dump(rows(spark, "2"), database, DAY, "a")
    assert publish.finish(spark, database) == [f"dt={DAY}/dump=a"]
    assert jobs(spark, database) == ["2"]
    assert publish.Folders(spark, database).names(f"{database}/{publish.STAGING}") == []


def test_days_of_several_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path)
    frame = lambda *pairs: spark.createDataFrame(pairs, "dt string, n long").withColumn("dt", F.col("dt").cast("date"))
    store.write_days(frame((DAY, 1), (NEXT, 2)), path)
    store.write_days(frame((NEXT, 3), ("2026-02-26", 4)), path, many_days=True)
    assert sorted((str(r["dt"]), r["n"]) for r in store.read_days(spark, path).collect()) == [(DAY, 1), (NEXT, 3), ("2026-02-26", 4)]
    # The rows may come from the table they replace.
    store.write_days(store.read_days(spark, path).where(f"dt = DATE'{DAY}'").withColumn("n", F.col("n") + 10), path)
    assert sorted(r["n"] for r in store.read_days(spark, path).collect()) == [3, 4, 11]


# Layouts


def test_layouts_are_read_as_one(spark, tmp_path):
    database = str(tmp_path / "db")
    texts = {
        "a.csv": ["JobID|State|ElapsedRaw", "1|COMPLETED|7"],
        "b.csv": ["ElapsedRaw|JobID|Restarts|State", "8|2|x|FAILED", "9|3||", "broken|line"],
    }
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    assert ingest(spark, str(tmp_path / "a.csv"), database, DAY, column_count=None).dropped == 0
    assert ingest(spark, str(tmp_path / "b.csv"), database, NEXT, column_count=None).dropped == 1
    narrow = spark.createDataFrame([("4", 6)], "JobID string, ElapsedRaw int").withColumn("dt", F.lit("2026-02-26").cast("date"))
    store.write_rows(narrow, database, "other")
    found = store.read_days(spark, database)
    assert dict(found.dtypes) == {"JobID": "string", "State": "string", "ElapsedRaw": "bigint", "Restarts": "string", "dt": "date"}
    got = sorted((r["JobID"], r["State"], r["ElapsedRaw"], r["Restarts"]) for r in found.collect())
    assert got == [("1", "COMPLETED", 7, None), ("2", "FAILED", 8, "x"), ("3", None, 9, None), ("4", None, 6, None)]
    assert jobs(spark, database, "2026-02-26") == ["4"] and len(layouts.known(spark, database)) == 3
    # The same layout again is not registered twice.
    ingest(spark, str(tmp_path / "a.csv"), database, DAY, column_count=None)
    assert len(layouts.known(spark, database)) == 3


def test_types_that_no_type_holds_are_refused_before_writing(spark, tmp_path):
    database = str(tmp_path)
    store.write_dump(rows(spark, "1"), database, DAY, "a")
    text = spark.createDataFrame([("2", "five")], "JobID string, ElapsedRaw string")
    with pytest.raises(layouts.LayoutConflict, match="ElapsedRaw holds bigint in some layouts and string"):
        store.write_dump(text, database, DAY, "a")
    assert jobs(spark, database) == ["1"]


def test_files_in_a_folder_may_have_different_layouts(spark, tmp_path):
    drop = tmp_path / "drop" / DAY
    drop.mkdir(parents=True)
    (drop / "a.csv").write_text("JobID|State\n1|A\n")
    (drop / "b.csv").write_text("State|Extra|JobID\nB|x|2\nB|2\n")
    want = [("1", "A", None), ("2", "B", "x")]
    pick = lambda df: sorted(map(tuple, df.select("JobID", "State", "Extra").collect()), key=repr)
    assert pick(dumps.read_dump(spark, str(drop), column_count=None)) == want
    result = ingest(spark, str(drop), str(tmp_path / "batch"), DAY, column_count=None)
    assert (result.lines, result.dropped) == (5, 1) and pick(store.read_days(spark, str(tmp_path / "batch"))) == want
    ingest_new_dumps(spark, str(drop), str(tmp_path / "stream"), str(tmp_path / "p"), columns=None).awaitTermination()
    assert pick(store.read_days(spark, str(tmp_path / "stream"))) == want
    (drop / "c.csv").write_text("JobID|JobID\n")
    with pytest.raises(ValueError, match="twice"):
        dumps.read_dump(spark, str(drop), column_count=None)


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i:04d}.csv").write_text("JobID|State\n" + f"{i}|A\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        found = dumps.headers(spark, dumps.lines_with_file(spark, str(tmp_path)).inputFiles(), 2)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) <= 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(files) for files in found.values()] == [300]


def test_files_are_united_by_name(spark, tmp_path):
    spark.createDataFrame([("1", "a")], "JobID string, State string").toPandas().to_parquet(tmp_path / f"{DAY}.parquet")
    spark.createDataFrame([("2", 4)], "JobID string, AllocCPUS long").toPandas().to_parquet(tmp_path / f"{NEXT}.parquet")
    found = store.read_files(spark, str(tmp_path)).select("JobID", "State", "AllocCPUS", F.col("dt").cast("string")).collect()
    assert sorted(map(tuple, found)) == [("1", "a", None, DAY), ("2", None, 4, NEXT)]


# Rejected lines


def test_rejected_lines_are_kept_with_their_reason(spark, tmp_path):
    path, database, rejects = tmp_path / f"{DAY}.csv", str(tmp_path / "db"), str(tmp_path / "rejects")
    line = lambda **v: "|".join(str(v.get(n, "")) for n in ACCOUNTING_COLUMNS)
    bad = [line(JobID="2", ElapsedRaw="five"), "broken|line", line(JobID="3", CPUTimeRAW="1.5", NNodes="x"), ""]
    path.write_text("\n".join(["|".join(ACCOUNTING_COLUMNS), line(JobID="1", ElapsedRaw=4), *bad]) + "\n")
    result = ingest(spark, str(path), database, DAY, rejects=rejects)
    assert (result.lines, result.dropped, result.bad_numbers) == (6, 2, 2)
    assert jobs(spark, database) == ["1"]
    kept = {r["value"]: (r["reason"], r["file"].rpartition("/")[2], r["dt"]) for r in store.read_days(spark, rejects).collect()}
    day = dt.date.fromisoformat(DAY)
    assert kept == {
        bad[0]: ("number: ElapsedRaw", f"{DAY}.csv", day), bad[1]: ("columns", f"{DAY}.csv", day),
        bad[2]: ("number: CPUTimeRAW", f"{DAY}.csv", day), bad[3]: ("columns", f"{DAY}.csv", day),
    }
    # A corrected dump leaves no rejects behind.
    path.write_text("\n".join(["|".join(ACCOUNTING_COLUMNS), line(JobID="1"), line(JobID="2", ElapsedRaw=5)]) + "\n")
    assert ingest(spark, str(path), database, DAY, rejects=rejects).bad_numbers == 0
    assert store.read_days(spark, rejects).count() == 0 and jobs(spark, database) == ["1", "2"]


def test_reasons(spark):
    names = ["JobID", "ElapsedRaw", "It's"]
    lines = ["JobID|ElapsedRaw|It's", "1|5|x", "1||", "1|5x|", "1|99999999999999999999|", "1|5", "1|5|6|7"]
    found = spark.createDataFrame([(v,) for v in lines], "value string").selectExpr(f"{rejection(names)} AS reason").collect()
    assert [r[0] for r in found] == [None, None, None, "number: ElapsedRaw", "number: ElapsedRaw", "columns", "columns"]


# Names over the whole history


def scanned(df):
    """Rows the file scan gave, after row groups were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_row_groups_without_a_name_are_skipped(spark, tmp_path):
    names = spark.range(0, 200_000, 1, 1).selectExpr("CAST(id AS string) AS JobID", "concat('run-', hash(id)) AS JobName", f"DATE'{DAY}' AS dt")
    with_filter, without = str(tmp_path / "with"), str(tmp_path / "without")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(256 << 10))
    hadoop.set("parquet.enable.dictionary", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store.write_rows(names.sortWithinPartitions("JobID"), with_filter)
        names.drop("dt").write.parquet(without)
        name = names.where("id = 77777").first()["JobName"]
        found = store.read_jobs_named(spark, with_filter, [name]).select("JobID")
        assert [r["JobID"] for r in found.collect()] == ["77777"]
        assert 0 < scanned(found) < 60_000
        assert scanned(spark.read.parquet(without).where(F.col("JobName") == name).select("JobID")) > 150_000
        assert store.read_jobs_named(spark, with_filter, ["run-nobody"]).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.enable.dictionary")


# Dumps delivered twice


def test_a_dump_delivered_again_under_another_name(spark, tmp_path):
    drop, database, progress = tmp_path / "drop", str(tmp_path / "db"), str(tmp_path / "p")
    (drop / DAY).mkdir(parents=True)
    run = lambda: ingest_new_dumps(spark, str(drop / "*"), database, progress, columns=["JobID", "State"], once_within="1 hour").awaitTermination()
    (drop / DAY / "a.csv").write_text("JobID|State\n1|A\n2|B\n")
    run()
    (drop / DAY / "b.csv").write_text("State|JobID\nA|1\nB|2\n")  # another order: other lines
    (drop / DAY / "again.csv").write_text("JobID|State\n1|A\n2|B\n")
    (drop / DAY / "longer.csv").write_text("JobID|State\n1|A\n2|B\n3|C\n")
    (drop / NEXT).mkdir()
    (drop / NEXT / "a.csv").write_text("JobID|State\n1|A\n")
    run()
    found = sorted((r["JobID"], r["State"], str(r["dt"])) for r in store.read_days(spark, database).collect())
    assert found == [("1", "A", DAY), ("1", "A", DAY), ("1", "A", NEXT), ("2", "B", DAY), ("2", "B", DAY), ("3", "C", DAY)]


def test_the_state_of_lines_is_bounded_by_time(spark, tmp_path):
    drop, database, progress = tmp_path / DAY, str(tmp_path / "db"), str(tmp_path / "p")
    drop.mkdir()
    kept = []
    for i in range(4):
        (drop / f"{i}.csv").write_text("JobID|State\n" + "".join(f"{i}{k}|A\n" for k in range(50)))
        query = ingest_new_dumps(spark, str(drop), database, progress, columns=["JobID", "State"], once_within="1 second")
        query.awaitTermination()
        kept.append(max(p["stateOperators"][0]["numRowsTotal"] for p in map(json.loads, [x.json for x in query.recentProgress]) if p["stateOperators"]))
        time.sleep(2)
    assert max(kept) <= 110 and store.read_days(spark, database).count() == 200


# Metrics documents


@pytest.mark.parametrize("flat", [False, True])
def test_only_documents_of_the_range_are_read(spark, tmp_path, flat):
    path, days = str(tmp_path / "m"), [dt.date(2026, 2, 1) + dt.timedelta(days=i) for i in range(20)]
    if flat:
        (tmp_path / "m").mkdir()
        for i, day in enumerate(days):
            (tmp_path / "m" / f"{day}.json").write_text(json.dumps({"global": {"CPU.Secondes": i}, "fast": {"CPU.Secondes": 1}}))
        (tmp_path / "m" / f"{days[4]}.parquet").write_text("not a document")
    else:
        found = spark.createDataFrame([(d, "global", None, float(i)) for i, d in enumerate(days)], "dt date, scope string, QOS string, cpu_seconds double")
        every = found.select("dt", "scope", "QOS", *[F.col("cpu_seconds").alias(n) for n in metrics.DAILY_METRICS])
        metrics.write_metrics_json(every, path)
    found = metrics.read_metrics_json(spark, path, days[3], days[6])
    assert sorted((r["dt"], r["cpu_seconds"]) for r in found.collect()) == [(days[i], float(i)) for i in range(3, 7)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert scanned(metrics.read_documents(spark, path, days[3], days[6])) == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
