"""The registered queries as plain SQL over the star tables, for checking the Spark results in another engine."""

from __future__ import annotations

from jobledger.sources.star_tables import ACCOUNTING, DUMP_LINES, INPUT_SIZES, JOB_DAYS, LAYOUT_LINES, LOG_LINES, MANIFEST

REPORT_DAY = "1997-05-01"
NEXT_DAY, THIRD_DAY = "1997-05-02", "1997-05-03"
PROJECTS = ("p0", "p1", "p2", "p3")
RANGE = ("1994-12-20", "2001-08-31")

# Fixed values, written out here so that a wrong one in the library shows.
CPU_CAPACITY, GB_CAPACITY = "36633600.0", "188611200.0"
RULE_HEADING = "Nom de la règle"
RULE_TABLES = {
    "MemEfficiencyPercent": [
        "Efficacité mémoire moyenne",
        "Efficacité mémoire médiane",
        "Efficacité mémoire (écart-type)",
        "Efficacité mémoire minimum",
        "Efficacité mémoire maximum",
    ],
    "CPUEfficiencyPercent": [
        "Efficacité CPU moyenne",
        "Efficacité CPU médiane",
        "Efficacité CPU (écart-type)",
        "Efficacité CPU minimum",
        "Efficacité CPU maximum",
    ],
    "ElapsedRaw": [
        "Durée moyenne",
        "Durée médiane",
        "Durée (écart-type)",
        "Durée minimum",
        "Durée maximum",
    ],
    "UsedRAMPerMo": [
        "RAM utilisée par Mo (moyenne)",
        "RAM utilisée par Mo (médiane)",
        "RAM utilisée par Mo (écart-type)",
        "RAM utilisée par Mo (minimum)",
        "RAM utilisée par Mo (maximum)",
    ],
    "MinPerMo": [
        "Minutes par Mo (moyenne)",
        "Minutes par Mo (médiane)",
        "Minutes par Mo (écart-type)",
        "Minutes par Mo (minimum)",
        "Minutes par Mo (maximum)",
    ],
}
# Fixed values too: the columns of the per-job export; those of the second list hold integers.
JOB_REPORT_COLUMNS = [
    "Account",
    "AllocCPUS",
    "AllocNodes",
    "AveCPU",
    "AveCPUFreq",
    "AveDiskRead",
    "AveDiskWrite",
    "AvePages",
    "AveRSS",
    "AveVMSize",
    "Comment",
    "CPUTime",
    "CPUTimeRAW",
    "DerivedExitCode",
    "Elapsed",
    "ElapsedRaw",
    "End",
    "ExitCode",
    "Flags",
    "Group",
    "JobID",
    "JobName",
    "MaxDiskRead",
    "MaxDiskReadNode",
    "MaxDiskReadTask",
    "MaxDiskWrite",
    "MaxDiskWriteNode",
    "MaxDiskWriteTask",
    "MaxPages",
    "MaxPagesNode",
    "MaxPagesTask",
    "MaxRSS",
    "MaxRSSNode",
    "MaxRSSTask",
    "MaxVMSize",
    "MaxVMSizeNode",
    "MaxVMSizeTask",
    "MinCPU",
    "MinCPUNode",
    "MinCPUTask",
    "NCPUS",
    "NNodes",
    "NodeList",
    "NTasks",
    "Partition",
    "QOS",
    "ReqCPUS",
    "ReqMem",
    "ReqNodes",
    "Start",
    "State",
    "Submit",
    "SubmitLine",
    "Suspended",
    "SystemCPU",
    "Timelimit",
    "TimelimitRaw",
    "TotalCPU",
    "User",
    "UserCPU",
    "WorkDir",
]
JOB_REPORT_INTEGERS = [
    "AllocCPUS",
    "AllocNodes",
    "AvePages",
    "CPUTimeRAW",
    "ElapsedRaw",
    "MaxDiskReadTask",
    "MaxDiskWriteTask",
    "MaxPages",
    "MaxPagesTask",
    "MaxRSSTask",
    "MaxVMSizeTask",
    "MinCPUTask",
    "NCPUS",
    "NNodes",
    "NTasks",
    "ReqCPUS",
    "ReqNodes",
]

CTES = {
    "acct": ACCOUNTING,
    "parsed": """
        SELECT * EXCLUDE (sfx), CASE WHEN sfx IS NULL THEN 'allocation' WHEN sfx = '.batch' THEN 'batch' WHEN sfx = '.extern' THEN 'extern'
            WHEN regexp_full_match(sfx, '\\.[0-9]+') THEN 'step' ELSE 'unknown' END "JobInfoType"
        FROM (SELECT *, nullif(regexp_extract("JobID", '^([0-9]+)', 1), '') "JobRoot", nullif(regexp_extract("JobID", '^[0-9]+(\\..+)', 1), '') sfx FROM acct)""",
    "sized": """
        SELECT * EXCLUDE ("MaxRSS", "ReqMem"),
            CAST(regexp_extract("MaxRSS", '([0-9]+)[KMGT]', 1) AS BIGINT) * CASE right("MaxRSS", 1) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 END "MaxRSS",
            CASE WHEN regexp_matches("ReqMem", '[KMGT]') THEN CAST(regexp_extract("ReqMem", '([0-9]+)[KMGT]', 1) AS BIGINT) * CASE right("ReqMem", 1) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 END END "ReqMem",
            CASE WHEN contains("JobID", '_') THEN (1 + CAST(regexp_extract("JobID", '_([0-9]+)', 1) AS BIGINT)) * 100000 ELSE 0 END
            + CASE split_part("JobID", '.', 2) WHEN '' THEN 0 WHEN 'batch' THEN 1000 WHEN 'extern' THEN 2000 ELSE 3000 + CAST(split_part("JobID", '.', 2) AS BIGINT) END ord
        FROM parsed""",
    "day_rows": """SELECT s.*, d.dt FROM sized s JOIN days d ON d.job = s."JobRoot" """,
    "days": JOB_DAYS,
    "input_sizes": INPUT_SIZES,
    "log_lines": LOG_LINES,
    "manifest": MANIFEST,
    "dump": DUMP_LINES,
    "layout_lines": LAYOUT_LINES,
}
TEXTS = "JobID Submit Start End TotalCPU State QOS Comment JobName User Elapsed Account NodeList JobInfoType".split()
NUMBERS = "ElapsedRaw AllocCPUS CPUTimeRAW MaxRSS ReqMem".split()


def _jobs(source: str, keys: str) -> str:
    texts = ", ".join(f'arg_min("{c}", ord) FILTER (WHERE "{c}" IS NOT NULL) "{c}"' for c in TEXTS)
    numbers = ", ".join(f'max("{c}") "{c}"' for c in NUMBERS)
    return f"""
        SELECT *, "MaxRSS" / 1073741824.0 "MaxRSS_G", "ReqMem" / 1073741824.0 "ReqMem_G", "MaxRSS" / "ReqMem" ratio, "MaxRSS" / "ReqMem" * 100 "MemEfficiencyPercent",
            CASE WHEN "CPUTimeRAW" = 0 THEN CASE WHEN "TotalCPU_seconds" = 0 THEN 0.0 ELSE 'inf'::DOUBLE END ELSE "TotalCPU_seconds" / "CPUTimeRAW" END * 100 "CPUEfficiencyPercent",
            nullif(regexp_extract("Comment", '^rule_(r[0-9]+)', 1), '') rule_name,
            nullif(regexp_extract("Comment", '_wildcards_(.+)', 1), '') wildcards,
            try_strptime("Submit", '%Y-%m-%dT%H:%M:%S') sub_ts, try_strptime("Start", '%Y-%m-%dT%H:%M:%S') start_ts, try_strptime("End", '%Y-%m-%dT%H:%M:%S') end_ts
        FROM (SELECT *, {_cpu_seconds('"TotalCPU"')} "TotalCPU_seconds" FROM (SELECT {keys}, {texts}, {numbers} FROM {source} GROUP BY {keys}))"""


def _cpu_seconds(t: str) -> str:
    def part(text, i):
        return f"CAST(split_part({text}, ':', {i}) AS BIGINT)"

    clock = f"split_part({t}, '-', 2)"
    return f"""CASE WHEN regexp_full_match({t}, '[0-9]+-[0-9]+:[0-9]+:[0-9]+') THEN CAST(split_part({t}, '-', 1) AS BIGINT) * 86400 + {part(clock, 1)} * 3600 + {part(clock, 2)} * 60 + {part(clock, 3)}
        WHEN regexp_full_match({t}, '[0-9]+:[0-9]+:[0-9]+') THEN {part(t, 1)} * 3600 + {part(t, 2)} * 60 + {part(t, 3)}
        WHEN regexp_full_match({t}, '[0-9]+:[0-9]+\\.[0-9]+') THEN {part(t, 1)} * 60 + CAST(split_part(split_part({t}, ':', 2), '.', 1) AS BIGINT) ELSE 0 END"""


CTES["jobs"] = _jobs("sized", '"JobRoot"')
CTES["day_jobs"] = _jobs("day_rows", 'dt, "JobRoot"')
CTES["history_rows"] = """SELECT s.* REPLACE (s.ord + date_diff('day', DATE '1970-01-01', d.dt) * 1000000000 AS ord) FROM sized s JOIN days d ON d.job = s."JobRoot" """
CTES["history_jobs"] = _jobs("history_rows", '"JobRoot"')
CTES["layout_fields"] = f"""
    SELECT *, CAST(DATE '{REPORT_DAY}' + CAST("era" AS INTEGER) AS VARCHAR) dt, string_split("value", '|') f, len(f) = 3 + "era" whole,
        CASE WHEN whole THEN f[CASE WHEN "era" = 1 THEN 2 ELSE 3 END] END el FROM layout_lines"""
CTES["runs"] = "SELECT * FROM jobs WHERE rule_name IS NOT NULL"
CTES["sized_runs"] = """
    SELECT r.*, i."slurm_jobid", i."job_id", i."rule_name" rule_name_1, i."input_size_bytes", i."inputs",
        ("ElapsedRaw" / 60.0) / (i."input_size_bytes" / 1048576.0) "MinPerMo", ("ReqMem" / 1048576.0) / (i."input_size_bytes" / 1048576.0) "UsedRAMPerMo"
    FROM runs r LEFT JOIN input_sizes i ON i."slurm_jobid" = r."JobID" AND i."input_size_bytes" <> 0"""
CTES["numbered"] = """
    SELECT *, sum(CASE WHEN starts_with("value", '[') THEN 1 ELSE 0 END) OVER (PARTITION BY "file" ORDER BY "line_no") record_id,
        nullif(regexp_extract("value", '^rule\\s+(\\S+):', 1), '') rule_name, nullif(regexp_extract("value", '^\\s*[iI][nN][pP][uU][tT]\\s*:\\s*(.+)', 1), '') input_text,
        nullif(regexp_extract("value", '^Job\\s+([0-9]+)\\s+has been submitted with SLURM jobid [0-9]+ \\(log: .+\\)\\.$', 1), '') job_id,
        nullif(regexp_extract("value", '^Job\\s+[0-9]+\\s+has been submitted with SLURM jobid ([0-9]+) \\(log: .+\\)\\.$', 1), '') slurm_jobid
    FROM log_lines"""
CTES["records"] = """
    SELECT "file", record_id, min("line_no") first_line, arg_max(slurm_jobid, "line_no") FILTER (WHERE job_id IS NOT NULL) slurm_jobid, arg_max(job_id, "line_no") FILTER (WHERE job_id IS NOT NULL) job_id,
        coalesce(arg_max(rule_name, "line_no") FILTER (WHERE rule_name IS NOT NULL), '') rule_name, arg_max(input_text, "line_no") FILTER (WHERE input_text IS NOT NULL) input_text
    FROM numbered WHERE record_id > 0 GROUP BY "file", record_id HAVING count(job_id) > 0"""
CTES["record_paths"] = """
    SELECT *, split_part("file", '/.snakemake/', 1) || '/' || trim(p) path
    FROM (SELECT *, unnest(string_split(input_text, ',')) p, unnest(range(len(string_split(input_text, ',')))) place FROM records)"""
CTES["log_sizes"] = """
    SELECT slurm_jobid, job_id, rule_name, CAST(coalesce(sum(m."length"), 0) AS BIGINT) input_size_bytes, string_agg(r.path, ',' ORDER BY place) "inputs"
    FROM record_paths r LEFT JOIN manifest m ON m."path" = r.path GROUP BY "file", record_id, slurm_jobid, job_id, rule_name"""
CTES["log_run_ids"] = """
    SELECT "file", substr(trim(arg_min("value", "line_no")), 15) run_id FROM log_lines WHERE contains("value", 'SLURM run ID: ') GROUP BY "file" """
CTES["logged_runs"] = """
    SELECT r.*, ("ElapsedRaw" / 60.0) / (i.input_size_bytes / 1048576.0) "MinPerMo", ("ReqMem" / 1048576.0) / (i.input_size_bytes / 1048576.0) "UsedRAMPerMo"
    FROM runs r LEFT JOIN log_sizes i ON i.slurm_jobid = r."JobID" AND i.input_size_bytes <> 0 WHERE r."JobName" IN (SELECT run_id FROM log_run_ids)"""

NEEDS = {
    "parsed": ["acct"],
    "sized": ["parsed"],
    "day_rows": ["sized", "days"],
    "jobs": ["sized"],
    "day_jobs": ["day_rows"],
    "history_rows": ["sized", "days"],
    "history_jobs": ["history_rows"],
    "layout_fields": ["layout_lines"],
    "runs": ["jobs"],
    "sized_runs": ["runs", "input_sizes"],
    "numbered": ["log_lines"],
    "records": ["numbered"],
    "record_paths": ["records"],
    "log_sizes": ["record_paths", "manifest"],
    "log_run_ids": ["log_lines"],
    "logged_runs": ["runs", "log_sizes", "log_run_ids"],
}


def _with(names: list[str], text: str) -> str:
    order: list[str] = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + text


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def _metrics(group: str, jobs: str, day: str, where: str = "") -> str:
    """The daily metrics as one grouped select; ``group`` is the leading select list."""
    wait, dur = "date_diff('second', sub_ts, start_ts)", "date_diff('second', start_ts, end_ts)"
    cpu, gb = 'coalesce(sum("TotalCPU_seconds"), 0)', 'coalesce(sum("MaxRSS" / 1073741824.0 * "ElapsedRaw"), 0)'
    columns = [
        f"CAST({cpu} AS BIGINT) cpu_seconds",
        _r(f"{cpu} / 3600.0", "cpu_hours"),
        _r(f"{cpu} / {CPU_CAPACITY} * 100", "cpu_usage_percent"),
        f"round({gb}, 3) gb_seconds",
        _r(f"{gb} / {GB_CAPACITY} * 100", "ram_usage_percent"),
        _r(f"avg({wait})", "wait_mean"),
        _r(f"median({wait})", "wait_median"),
        f"min({wait}) wait_min",
        f"max({wait}) wait_max",
        f"count(*) FILTER (WHERE CAST(sub_ts AS DATE) = {day}) jobs_submitted",
        f"count(*) FILTER (WHERE CAST(start_ts AS DATE) = {day}) jobs_started",
        f"count(*) FILTER (WHERE CAST(start_ts AS DATE) = {day}) jobs_ended",
        "count(*) FILTER (WHERE \"State\" = 'COMPLETED') jobs_completed",
        "count(*) FILTER (WHERE \"State\" = 'FAILED') jobs_failed",
        "count(*) FILTER (WHERE \"State\" = 'PREEMPTED') jobs_preempted",
        _r(f"avg({dur})", "duration_mean"),
        _r(f"median({dur})", "duration_median"),
        f"min({dur}) duration_min",
        f"max({dur}) duration_max",
        f"count(*) FILTER (WHERE CAST(end_ts AS DATE) = {day}) jobs_ended_on_day",
    ]
    return f"SELECT {group}, {', '.join(columns)} FROM {jobs} {where}"


DAY = f"DATE '{REPORT_DAY}'"
STATS = {"mean": "avg", "median": "median", "std": "stddev_samp", "min": "min", "max": "max"}


def _stat(function: str, measure: str) -> str:
    """Smallest and largest value leave out NaN, which this engine takes for the largest of all."""
    value = f'CAST("{measure}" AS DOUBLE)'
    return f"{function}({value})" + (f" FILTER (WHERE NOT isnan({value}))" if function in ("min", "max") else "")


def _statistics(source: str, measures: list[str]) -> str:
    columns = [
        f'round({_stat(function, m)}, 6) "{m}_{name}"' for m in measures for name, function in STATS.items()
    ]
    firsts = [f'arg_min("{c}", CAST("JobRoot" AS BIGINT)) FILTER (WHERE "{c}" IS NOT NULL) "{c}"' for c in ("QOS", "Account", "NodeList")]
    return f"""SELECT rule_name, {', '.join(columns)}, min("Elapsed") "Elapsed_min", max("Elapsed") "Elapsed_max", {', '.join(firsts)}
        FROM {source} GROUP BY rule_name"""


def _table(source: str, measure: str) -> str:
    cells = [f'round({_stat(f, measure)}, 6) "{h}"' for f, h in zip(STATS.values(), RULE_TABLES[measure])]
    return f'SELECT rule_name AS "{RULE_HEADING}", {", ".join(cells)} FROM {source} GROUP BY rule_name'


def _boxes(source: str, key: str, value: str, method: str) -> str:
    """Box plot parts per group: quartiles from the sorted list of values."""

    def quantile(p):
        h = f"{p} * (n - 1)" if method == "linear" else f"least(greatest({p} * n - 0.5, 0), n - 1)"
        low, high = f"l[CAST(floor({h}) AS BIGINT) + 1]", f"l[CAST(ceil({h}) AS BIGINT) + 1]"
        return f"{low} + ({high} - {low}) * ({h} - floor({h}))"

    return f"""grouped AS (SELECT {key} k, count(v) n, list(v ORDER BY v) l FROM (SELECT {key}, CAST({value} AS DOUBLE) v FROM {source}) WHERE v IS NOT NULL GROUP BY {key}),
        quartiles AS (SELECT k, n, {quantile(0.25)} q1, {quantile(0.5)} median, {quantile(0.75)} q3 FROM grouped),
        points AS (SELECT q.*, CAST({value} AS DOUBLE) v FROM {source} s JOIN quartiles q ON s.{key} = q.k WHERE {value} IS NOT NULL)"""


OUTSIDE = "(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))"
SUSPECTED = "(v < 4 * q1 - 3 * q3 OR v > 4 * q3 - 3 * q1)"


def _box_statistics(ctes: list[str], source: str, key: str, value: str, method: str) -> str:
    prefix = _with(ctes, "").rstrip() + ",\n" if ctes else "WITH "
    return f"""{prefix}{_boxes(source, key, value, method)}
        SELECT k {key}, any_value(n) "count", {_r('min(v)', '"min"')}, {_r('any_value(q1)', 'q1')}, {_r('any_value(median)', 'median')}, {_r('any_value(q3)', 'q3')}, {_r('max(v)', '"max"')},
            {_r('any_value(q3) - any_value(q1)', 'iqr')}, {_r(f'least(any_value(q1), min(v) FILTER (WHERE NOT {OUTSIDE}))', 'whisker_low')},
            {_r(f'greatest(any_value(q3), max(v) FILTER (WHERE NOT {OUTSIDE}))', 'whisker_high')},
            count_if({OUTSIDE}) outliers, count_if({OUTSIDE} AND {SUSPECTED}) suspected_outliers FROM points GROUP BY k"""


def _box_points(ctes: list[str], source: str, key: str, value: str, method: str) -> str:
    prefix = _with(ctes, "").rstrip() + ",\n" if ctes else "WITH "
    return f"""{prefix}{_boxes(source, key, value, method)}
        SELECT k {key}, {_r('v', '"value"')}, count(*) n, bool_or({SUSPECTED}) suspected FROM points WHERE {OUTSIDE} GROUP BY k, v"""


def _band(v: str) -> str:
    return f"""CASE WHEN {v} IS NULL OR {v} = 0 OR isnan({v}) THEN NULL WHEN {v} > 150 THEN '#ff0000' WHEN {v} BETWEEN 0 AND 20 THEN '#ff0000' WHEN {v} BETWEEN 21 AND 60 THEN '#d4a500'
        WHEN {v} BETWEEN 61 AND 75 THEN '#ffa500' WHEN {v} BETWEEN 76 AND 100 THEN '#008000' WHEN {v} BETWEEN 101 AND 125 THEN '#ffa500' WHEN {v} BETWEEN 126 AND 150 THEN '#ff0000' END"""


def _report_columns() -> str:
    types = {c: "BIGINT" if c in JOB_REPORT_INTEGERS else "VARCHAR" for c in JOB_REPORT_COLUMNS}
    known = set(TEXTS + NUMBERS)
    return ", ".join(f'"{c}"' if c in known else f'CAST(NULL AS {types[c]}) "{c}"' for c in JOB_REPORT_COLUMNS)


def _hours(day: str) -> str:
    return f"""CASE WHEN CAST(start_ts AS DATE) = {day} AND CAST(end_ts AS DATE) = {day} THEN date_diff('second', start_ts, end_ts) / 3600.0
        WHEN start_ts < {day} AND CAST(end_ts AS DATE) = {day} THEN date_diff('second', CAST({day} AS TIMESTAMP), end_ts) / 3600.0
        WHEN CAST(start_ts AS DATE) = {day} AND end_ts >= {day} + INTERVAL 1 DAY THEN date_diff('second', start_ts, {day} + INTERVAL 1 DAY) / 3600.0
        WHEN start_ts < {day} AND end_ts >= {day} + INTERVAL 1 DAY THEN 24.0 ELSE 0.0 END"""


ROW_COLUMNS = [c for c in TEXTS if c != "JobInfoType"] + ["ElapsedRaw", "AllocCPUS", "CPUTimeRAW", "MaxRSS", "ReqMem"]
SHORT = '"JobRoot", "JobID"'
EFFICIENCY = f"""SELECT {SHORT}, "User", "State", "QOS", {_r('"ReqMem_G"', 'req_gb')}, {_r('"MaxRSS_G"', 'rss_gb')}, {_r('"MemEfficiencyPercent"', 'mem_percent')},
    "TotalCPU_seconds" cpu_seconds, {_r('"CPUEfficiencyPercent"', 'cpu_percent')} FROM jobs"""
CALENDAR = f"""cal AS (SELECT CAST(d AS DATE) d FROM generate_series(TIMESTAMP '{RANGE[0]}', TIMESTAMP '{RANGE[1]}', INTERVAL 1 DAY) t(d)),
    daily AS (SELECT dt, sum("TotalCPU_seconds") / {CPU_CAPACITY} * 100 cpu, coalesce(sum("MaxRSS" / 1073741824.0 * "ElapsedRaw"), 0) / {GB_CAPACITY} * 100 ram FROM day_jobs GROUP BY dt),
    series AS (SELECT d, dt IS NOT NULL has_data, coalesce(ram, 0) ram, coalesce(cpu, 0) cpu FROM cal LEFT JOIN daily ON dt = d)"""
QOS_LINE = "'qos' \"scope\", \"QOS\""
GLOBAL_LINE = "'global' \"scope\", CAST(NULL AS VARCHAR) \"QOS\""
DUMP_FIELDS = """CAST(nullif(split_part("value", '|', 1), '') AS VARCHAR) "JobID", nullif(split_part("value", '|', 2), '') "State",
    nullif(split_part("value", '|', 3), '') "QOS", nullif(split_part("value", '|', 4), '') "Comment" """
WHOLE = """len(string_split("value", '|')) = 4"""


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    return found | {"stored_calendar": found["metric_calendar"], "job_export": found["job_report"], "post_run_files": found["post_run_statistics"]}


def _oracle_sql() -> dict[str, str]:
    all_days = (
        _metrics(f"CAST(dt AS VARCHAR) dt, {QOS_LINE}", "day_jobs", "dt", 'GROUP BY dt, "QOS"')
        + " UNION ALL "
        + _metrics(f"CAST(dt AS VARCHAR) dt, {GLOBAL_LINE}", "day_jobs", "dt", "GROUP BY dt")
    )
    one_day_qos = _metrics(f"'{REPORT_DAY}' dt, {QOS_LINE}", "jobs", DAY, 'GROUP BY "QOS"')
    one_day_global = _metrics(f"'{REPORT_DAY}' dt, {GLOBAL_LINE}", "jobs", DAY)
    in_range = f"WHERE dt BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' GROUP BY dt"
    return {
        "job_kind": _with(["parsed"], 'SELECT "JobID", "JobRoot", "JobInfoType" FROM parsed'),
        "size_units": _with(
            ["acct"],
            """SELECT "JobID", nullif(regexp_extract("MaxRSS", '([0-9]+)[KMGT]', 1), '') rss_digits, nullif(regexp_extract("MaxRSS", '[0-9]+([KMGT])', 1), '') rss_unit,
            nullif(regexp_extract("ReqMem", '([0-9]+)[KMGT]', 1), '') req_digits, nullif(regexp_extract("ReqMem", '[0-9]+([KMGT])', 1), '') req_unit FROM acct""",
        ),
        "size_bytes": _with(
            ["sized"],
            f"""SELECT "JobID", "MaxRSS" rss_bytes, "ReqMem" req_bytes, {_r('"MaxRSS" / 1073741824.0', 'rss_gb')}, {_r('"ReqMem" / 1073741824.0', 'req_gb')} FROM sized""",
        ),
        "total_cpu_seconds": _with(["acct"], f"""SELECT "JobID", "TotalCPU", {_cpu_seconds('"TotalCPU"')} cpu_seconds FROM acct"""),
        "rule_name_parse": _with(
            ["acct"],
            """SELECT "JobID", nullif(regexp_extract("Comment", '^rule_(r[0-9]+)', 1), '') rule_name, nullif(regexp_extract("Comment", '_wildcards_(.+)', 1), '') wildcards FROM acct""",
        ),
        "per_job": _with(["jobs"], f'SELECT "JobRoot", {", ".join(chr(34) + c + chr(34) for c in TEXTS + NUMBERS)} FROM jobs'),
        "merged_job_state": _with(["history_jobs"], f'SELECT "JobRoot", {", ".join(chr(34) + c + chr(34) for c in TEXTS + NUMBERS)} FROM history_jobs'),
        "layout_history": _with(
            ["layout_fields"],
            """SELECT f[CASE WHEN "era" = 2 THEN 2 ELSE 1 END] "JobID", f[CASE "era" WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END] "State", CAST(nullif(el, '') AS BIGINT) "ElapsedRaw",
            CASE WHEN "era" > 0 THEN f[4] END "QOS", CASE WHEN "era" = 2 THEN f[5] END "Restarts", dt FROM layout_fields WHERE whole AND el <> 'unknown'""",
        ),
        "rejected_lines": _with(
            ["layout_fields"],
            """SELECT dt, CASE WHEN whole THEN 'number: ElapsedRaw' ELSE 'columns' END reason, count(*) AS "lines" FROM layout_fields
            WHERE "era" < 2 AND (NOT whole OR el = 'unknown') GROUP BY ALL""",
        ),
        "redelivered_dump": _with(["dump"], f"SELECT {DUMP_FIELDS}, '{REPORT_DAY}' dt FROM (SELECT DISTINCT * FROM dump) WHERE {WHOLE}"),
        "job_name_history": _with(
            ["acct", "days"],
            """SELECT "JobID", "JobName", "State", CAST(dt AS VARCHAR) dt FROM acct JOIN days ON job = regexp_extract("JobID", '^([0-9]+)', 1) WHERE "JobName" IN ('run-late', 'run-3')""",
        ),
        "growing_logs": _with(["records"], "SELECT slurm_jobid, job_id, rule_name, replace(input_text, ', ', ',') inputs FROM records"),
        "period_medians": _with(["day_jobs"], " UNION ALL ".join(
            f"""SELECT CAST(CAST(date_trunc('year', dt) AS DATE) AS VARCHAR) period, {line}, {_r("median(date_diff('second', sub_ts, start_ts))", 'wait_median')}, {_r("median(date_diff('second', start_ts, end_ts))", 'duration_median')}
            FROM day_jobs WHERE dt BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' GROUP BY date_trunc('year', dt){group}""" for line, group in ((QOS_LINE, ', "QOS"'), (GLOBAL_LINE, ""))
        )),
        "job_efficiency": _with(["jobs"], EFFICIENCY),
        "job_report": _with(
            ["jobs"],
            f"""SELECT {_report_columns()}, {_r('"ReqMem_G"', '"ReqMem_G"')}, {_r('"MaxRSS_G"', '"MaxRSS_G"')}, {_r('"MemEfficiencyPercent"', '"MemEfficiencyPercent"')},
            {_r('"CPUEfficiencyPercent"', '"CPUEfficiencyPercent"')} FROM jobs""",
        ),
        "wait_times": _with(
            ["jobs"],
            f"""SELECT {SHORT}, date_diff('second', sub_ts, start_ts) wait_time_seconds, {_r("date_diff('second', sub_ts, start_ts) / 3600.0", 'wait_time_hours')} FROM jobs""",
        ),
        "job_durations": _with(["jobs"], f"SELECT {SHORT}, date_diff('second', start_ts, end_ts) job_duration_seconds FROM jobs"),
        "daily_duration": _with(["jobs"], f"SELECT {SHORT}, {_r(_hours(DAY), 'daily_duration_hours')}, '{REPORT_DAY}' \"date\" FROM jobs"),
        "daily_duration_all_days": _with(
            ["jobs"],
            f"""SELECT CAST(d AS VARCHAR) "date", count(*) jobs, {_r('sum(h)', 'hours')} FROM (SELECT d, {_hours('d')} h FROM
            (SELECT start_ts, end_ts, CAST(unnest(generate_series(date_trunc('day', start_ts), date_trunc('day', end_ts), INTERVAL 1 DAY)) AS DATE) d FROM jobs WHERE end_ts IS NOT NULL)) GROUP BY d""",
        ),
        "daily_metrics_qos": _with(["jobs"], one_day_qos),
        "daily_metrics_global": _with(["jobs"], one_day_global),
        "daily_metrics": _with(["jobs"], f"{one_day_qos} UNION ALL {one_day_global}"),
        "daily_metrics_all_days": _with(["day_jobs"], all_days),
        "metrics_json_range": _with(["day_jobs"], _metrics("CAST(dt AS VARCHAR) dt", "day_jobs", "dt", in_range)).replace(
            ", count(*) FILTER (WHERE CAST(end_ts AS DATE) = dt) jobs_ended_on_day", ""
        ),
        "metric_calendar": _with(["day_jobs"], "").rstrip()
        + f""",\n{CALENDAR} SELECT CAST(d AS VARCHAR) dt, has_data, {_r('ram', 'ram_usage_percent')}, {_r('cpu', 'cpu_usage_percent')} FROM series""",
        "calendar_summary": _with(["day_jobs"], "").rstrip()
        + f""",\n{CALENDAR} SELECT 'ram_usage_percent' metric, round(min(ram), 2) min_value, round(max(ram), 2) max_value, count_if(has_data) days_with_data FROM series
            UNION ALL SELECT 'cpu_usage_percent', round(min(cpu), 2), round(max(cpu), 2), count_if(has_data) FROM series""",
        "job_name_filter": _with(["jobs"], f"""SELECT {SHORT}, "JobName" FROM jobs WHERE contains("JobName", 'n-3') OR contains("JobName", 'run-7')"""),
        "job_name_exact": _with(["acct"], """SELECT "JobID", "JobName", "State" FROM acct WHERE "JobName" IN ('run-1', 'run-2')"""),
        "run_id_jobs": _with(["jobs", "log_run_ids"], f"""SELECT {SHORT}, "JobName" FROM jobs WHERE "JobName" IN (SELECT run_id FROM log_run_ids)"""),
        "rule_runs": _with(["runs"], f"""SELECT {SHORT}, rule_name, wildcards, {_r('"MemEfficiencyPercent"', 'mem_percent')} FROM runs"""),
        "distinct_rules": _with(["runs"], "SELECT DISTINCT rule_name FROM runs"),
        "rule_statistics": _with(["runs"], _statistics("runs", ["MemEfficiencyPercent", "CPUEfficiencyPercent", "ElapsedRaw"])),
        "rule_statistics_sized": _with(["sized_runs"], _statistics("sized_runs", list(RULE_TABLES))),
        "input_size_join": _with(
            ["sized_runs"],
            f"""SELECT {SHORT}, rule_name, "slurm_jobid", "job_id", rule_name_1, "input_size_bytes", "inputs", {_r('"MinPerMo"', '"MinPerMo"')}, {_r('"UsedRAMPerMo"', '"UsedRAMPerMo"')} FROM sized_runs""",
        ),
        "memory_table": _with(["runs"], _table("runs", "MemEfficiencyPercent")),
        "cpu_table": _with(["runs"], _table("runs", "CPUEfficiencyPercent")),
        "runtime_table": _with(["runs"], _table("runs", "ElapsedRaw")),
        "relative_memory_table": _with(["sized_runs"], _table("sized_runs", "UsedRAMPerMo")),
        "relative_runtime_table": _with(["sized_runs"], _table("sized_runs", "MinPerMo")),
        "shown_cpu_table": _with(["runs"], "SELECT ")
        + f'rule_name AS "{RULE_HEADING}", '
        + ", ".join(
            f'round(CAST({f}("CPUEfficiencyPercent") AS DOUBLE), 3) "{h}"'
            + ("" if f == "stddev_samp" else f', {_band(f"""CAST({f}("CPUEfficiencyPercent") AS DOUBLE)""")} "{h} (couleur)"')
            for f, h in zip(STATS.values(), RULE_TABLES["CPUEfficiencyPercent"])
        )
        + " FROM runs GROUP BY rule_name",
        "efficiency_bands": _with(
            ["jobs"], f"""SELECT {SHORT}, {_band('"MemEfficiencyPercent"')} mem_colour, {_band('"CPUEfficiencyPercent"')} cpu_colour FROM jobs"""
        ),
        "duration_labels": _with(
            ["jobs"],
            f"""SELECT {SHORT}, CASE WHEN s IS NULL THEN 'N/A' WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || CAST(s % 3600 // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's'
            WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' ELSE CAST(s AS VARCHAR) || 's' END label, printf('%.2f', CAST(coalesce(s, 0) AS DOUBLE)) shown
            FROM (SELECT *, date_diff('second', start_ts, end_ts) s FROM jobs)""",
        ),
        "box_statistics": _box_statistics(["runs"], "runs", "rule_name", '"MemEfficiencyPercent"', "hazen"),
        "box_statistics_linear": _box_statistics(["runs"], "runs", "rule_name", '"ElapsedRaw"', "linear"),
        "box_statistics_sized": _box_statistics(["sized_runs"], "sized_runs", "rule_name", '"UsedRAMPerMo"', "hazen"),
        "box_statistics_events": _box_statistics([], "events", "event_type", "value", "linear"),
        "box_points": _box_points(["runs"], "runs", "rule_name", '"MemEfficiencyPercent"', "hazen"),
        "box_points_events": _box_points([], "events", "event_type", "value", "hazen"),
        "log_records": _with(["records"], 'SELECT "file", first_line, slurm_jobid, job_id, rule_name, replace(input_text, \', \', \',\') inputs FROM records'),
        "log_input_sizes": _with(["log_sizes"], "SELECT * FROM log_sizes"),
        "log_run_ids": _with(["log_run_ids"], "SELECT * FROM log_run_ids"),
        "input_sizes_csv": _with(["log_sizes"], "SELECT * FROM log_sizes"),
        "post_run_statistics": _with(["logged_runs"], _statistics("logged_runs", list(RULE_TABLES))),
        "stored_daily_report": _with(
            ["day_jobs"],
            _metrics(f"CAST(dt AS VARCHAR) dt, {QOS_LINE}", "day_jobs", "dt", f'WHERE dt = {DAY} GROUP BY dt, "QOS"')
            + " UNION ALL "
            + _metrics(f"CAST(dt AS VARCHAR) dt, {GLOBAL_LINE}", "day_jobs", "dt", f"WHERE dt = {DAY} GROUP BY dt"),
        ),
        "batch_and_stream": _with(
            ["dump"], f"""SELECT {DUMP_FIELDS}, CASE WHEN length("value") % 2 = 0 THEN '{REPORT_DAY}' ELSE '{NEXT_DAY}' END dt FROM dump WHERE {WHOLE}"""
        ),
        "database_files": _with(
            ["acct", "days"],
            """SELECT "JobID", "State", CAST(dt AS VARCHAR) dt FROM acct JOIN days ON job = regexp_extract("JobID", '^([0-9]+)', 1) WHERE year(dt) = 1997 OR dt = DATE '1998-01-01'""",
        ),
        "file_sizes": _with(["log_lines"], """SELECT split_part("file", '/', 3) project, CAST(sum(strlen("value") + 1) AS BIGINT) "length" FROM log_lines GROUP BY 1"""),
        "sanitized_lines": _with(["dump"], f'SELECT "value" FROM dump WHERE {WHOLE}'),
        "sanitizer_counts": _with(["dump"], f"SELECT count(*) total, count_if({WHOLE}) kept, count_if(NOT {WHOLE}) dropped FROM dump"),
        "ingested_dump": _with(["dump"], f"SELECT {DUMP_FIELDS}, '{REPORT_DAY}' dt FROM dump WHERE {WHOLE}"),
        "streamed_dump": _with(["dump"], f"SELECT {DUMP_FIELDS}, '{REPORT_DAY}' dt FROM dump WHERE {WHOLE}"),
        "delimited_scan": _with(["acct"], f"""SELECT {", ".join(f'"{c}"' for c in ROW_COLUMNS)} FROM acct"""),
        "stored_rule_statistics": _with(["sized_runs"], _statistics("sized_runs", list(RULE_TABLES))),
        "log_files": _with(["records"], "SELECT slurm_jobid, job_id, rule_name, replace(input_text, ', ', ',') inputs FROM records"),
        "database_day": _with(["acct", "days"], f"""SELECT "JobID", "ElapsedRaw", "MaxRSS" FROM acct JOIN days ON job = regexp_extract("JobID", '^([0-9]+)', 1) WHERE dt = {DAY}"""),
    }
