import random

import pytest
from pyspark.sql import functions as F

from jobledger.operators.logs import add_chunks, clean_path, log_input_sizes, log_records, resolve_inputs, run_ids
from jobledger.plans.logs import extract_logs
from jobledger.plans.rules import post_run_report
from jobledger.sources.dumps import read_input_sizes
from jobledger.sources.workflow_logs import file_manifest, read_log_lines

LOG = """preamble, ignored
SLURM run ID: 1a2b-3c4d
rule early:
[Tue Feb 24 10:00:00 2026]
rule align:
    input: data/a.fq, data/b.fq
    jobid: 3
Job 3 has been submitted with SLURM jobid 12345 (log: logs/align/3.log).
SLURM run ID: second
[Tue Feb 24 10:01:00 2026]
localrule all:
    Input : /abs//x/../y.txt
job 4 HAS been submitted with slurm jobid 12346 (log: logs/all/4.log).
[Tue Feb 24 10:02:00 2026]
rule bare:
Job 5 has been submitted with SLURM jobid 12347 (log: logs/5.log).
Job 6 has been submitted with SLURM jobid 12348 (log: logs/6.log).
[Tue Feb 24 10:05:00 2026]
Finished jobid: 3
"""


def numbered(spark, logs, chunk=65536):
    rows = [(f, i, line) for f, text in logs.items() for i, line in enumerate(text.splitlines())]
    random.Random(3).shuffle(rows)
    return add_chunks(spark.createDataFrame(rows, "file string, line_no long, value string").repartition(3), chunk)


# What the log above holds, written by hand.
RECORDS = [
    {"first_line": 3, "slurm_jobid": "12345", "job_id": "3", "rule_name": "align", "inputs": ["data/a.fq", "data/b.fq"]},
    {"first_line": 9, "slurm_jobid": "12346", "job_id": "4", "rule_name": "", "inputs": ["/abs//x/../y.txt"]},
    {"first_line": 13, "slurm_jobid": "12348", "job_id": "6", "rule_name": "bare", "inputs": None},
]


def written(rng, blocks):
    """A log and its records: each block is made from the record it stands for, in any order of lines, with noise."""
    lines, records = ["before", "rule lost:"], []
    for i in range(blocks):
        record = {"first_line": len(lines), "slurm_jobid": None, "job_id": None, "rule_name": "", "inputs": None}
        body = ["noise"] * rng.randrange(3)
        if rng.random() < 0.7:
            record["rule_name"] = f"r{rng.randrange(9)}"
            body.append(f"rule {record['rule_name']}:")
        if rng.random() < 0.7:
            record["inputs"] = [f"f{i}", "g h"][: rng.randint(1, 2)]
            body.append(f"   {rng.choice(['input', 'INPUT'])}: {', '.join(record['inputs'])}")
        if rng.random() < 0.7:
            record["job_id"], record["slurm_jobid"] = str(i), str(1000 + i)
            body.append(f"Job {i} has been submitted with SLURM jobid {1000 + i} (log: x.log).")
        rng.shuffle(body)
        lines += [f"[block {i}]", *body]
        records += [record] if record["job_id"] else []
    return "\n".join(lines), records


def collected(df):
    names = ["first_line", "slurm_jobid", "job_id", "rule_name", "inputs"]
    return sorted(({n: r[n] for n in names} for r in df.collect()), key=lambda r: r["first_line"])


def test_records(spark):
    got = collected(log_records(numbered(spark, {"/p/.snakemake/log/1.log": LOG})))
    assert [{**r, "inputs": r["inputs"] or None} for r in got] == RECORDS


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 7, 1000])
def test_records_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(chunk)
    text, known = written(rng, 80)
    silent = "\n".join(["nothing"] * 20)
    lines = numbered(spark, {"one": text, "two": LOG, "three": silent}, chunk)
    records = log_records(lines)
    for name, want in (("one", known), ("two", RECORDS), ("three", [])):
        got = collected(records.where(F.col("file") == name))
        assert [{**r, "inputs": r["inputs"] or None} for r in got] == want


def test_run_ids(spark):
    lines = numbered(spark, {"a": LOG, "b": "x\n  note SLURM run ID: q \n", "c": "nothing"}, 2)
    assert {r["file"]: r["run_id"] for r in run_ids(lines).collect()} == {"a": "1a2b-3c4d", "b": " ID: q"}


def test_paths(spark):
    texts = ["/a/b", "/a//b", "/a/./b/../c", "/../x", "rel/x", "/a/b/", "/a/..b/.c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string").orderBy("i")
    assert [r[0] for r in df.select(F.expr(clean_path("p"))).collect()] == ["/a/b", "/a/b", "/a/c", "/x", "rel/x", "/a/b", "/a/..b/.c"]


def test_sizes(spark):
    manifest = spark.createDataFrame([("/p/data/a.fq", 10), ("/p/data/b.fq", 5), ("/y.txt", 7), ("/abs/y.txt", 100)], "path string, length long")
    sizes = log_input_sizes(numbered(spark, {"/p/.snakemake/log/1.log": LOG}), manifest)
    got = {r["slurm_jobid"]: (r["job_id"], r["rule_name"], r["input_size_bytes"], r["inputs"]) for r in sizes.collect()}
    assert got == {
        "12345": ("3", "align", 15, "/p/data/a.fq,/p/data/b.fq"),
        "12346": ("4", "", 100, "/abs/y.txt"),
        "12348": ("6", "bare", 0, ""),
    }


def test_logs_outside_a_project(spark):
    records = log_records(numbered(spark, {"/tmp/other/1.log": LOG}))
    assert resolve_inputs(records).orderBy("first_line").collect()[0]["inputs"] == ["data/a.fq", "data/b.fq"]
    assert resolve_inputs(records, "/w").orderBy("first_line").collect()[0]["inputs"] == ["/w/data/a.fq", "/w/data/b.fq"]


def write_project(folder):
    logs = folder / "my project+1" / ".snakemake" / "log"
    logs.mkdir(parents=True)
    data = folder / "my project+1" / "data"
    data.mkdir()
    (data / "a.fq").write_text("x" * 10)
    (data / "b.fq").write_text("y" * 5)
    (logs / "1.log").write_bytes(LOG.replace("preamble", "pre\xff").encode("latin-1"))
    return logs, data


def test_files(spark, tmp_path):
    logs, data = write_project(tmp_path)
    lines = read_log_lines(spark, str(logs))
    assert lines.where("startswith(value, 'pre')").collect()[0]["value"] == "pre, ignored"
    sizes, ids = extract_logs(spark, str(logs), file_manifest(spark, str(data)), csv=str(tmp_path / "csv"))
    assert [r["run_id"] for r in ids.collect()] == ["1a2b-3c4d"]
    assert {r["slurm_jobid"]: r["input_size_bytes"] for r in sizes.collect()} == {"12345": 15, "12346": 0, "12348": 0}
    stored = {r["slurm_jobid"]: r for r in read_input_sizes(spark, str(tmp_path / "csv")).collect()}
    assert stored["12345"]["inputs"].endswith("my project+1/data/b.fq") and stored["12346"]["rule_name"] == ""
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_log_lines(spark, str(tmp_path / "absent.log"))


def test_splitting_a_file_gives_the_same_records(spark, tmp_path):
    text = "\n".join(LOG for _ in range(200))
    (tmp_path / "big.log").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_log_lines(spark, str(tmp_path / "big.log"))
        assert lines.select("chunk").distinct().count() > 10
        got = sorted((r["slurm_jobid"], r["rule_name"], tuple(r["inputs"])) for r in log_records(lines).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((r["slurm_jobid"], r["rule_name"], tuple(r["inputs"] or ())) for r in RECORDS * 200)


def test_post_run_report(spark, accounting, tmp_path):
    logs, data = write_project(tmp_path)
    rows = accounting(
        {"JobID": "12345", "JobName": "1a2b-3c4d", "Comment": "rule_align_wildcards_x", "ReqMem": "1G", "MaxRSS": "512M", "ElapsedRaw": 60},
        {"JobID": "12348", "JobName": "1a2b-3c4d", "Comment": "rule_bare", "ReqMem": "1G", "MaxRSS": "256M", "ElapsedRaw": 60},
        {"JobID": "777", "JobName": "1a2b-3c4d-other", "Comment": "rule_align", "ReqMem": "1G", "MaxRSS": "1G", "ElapsedRaw": 60},
    )
    report = post_run_report(spark, str(logs), rows, file_manifest(spark, str(data)), output=str(tmp_path / "out"), sizes_output=str(tmp_path / "sizes"))
    stats = {r["rule_name"]: r for r in report.statistics.collect()}
    assert stats["align"]["MemEfficiencyPercent_max"] == 50.0 and stats["bare"]["UsedRAMPerMo_mean"] is None
    assert stats["align"]["MinPerMo_mean"] == pytest.approx(1 / (15 / 2**20))
    assert read_input_sizes(spark, str(tmp_path / "sizes")).count() == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 2
    report.close()


def test_a_hot_file_is_split_by_adaptive_execution(spark):
    """Two thirds of all records use one input file: its join partition is cut, and every size is still right."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    body = "\n".join(
        f"[{i}]\nrule r:\n input: {'hot' if i % 3 else 'cold%d' % i}\nJob {i} has been submitted with SLURM jobid {i} (log: x)." for i in range(6000)
    )
    lines = numbered(spark, {"/p/.snakemake/log/1.log": body}, 50)
    manifest = spark.createDataFrame([("/p/hot", 3)] + [(f"/p/cold{i}", 1) for i in range(0, 6000, 3)], "path string, length long")
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        sizes = log_input_sizes(lines, manifest)
        got = {int(r["slurm_jobid"]): r["input_size_bytes"] for r in sizes.collect()}
        plan = sizes._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert got == {i: 3 if i % 3 else 1 for i in range(6000)}
    assert "SortMergeJoin(skew=true)" in plan
