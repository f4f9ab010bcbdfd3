"""Accounting rows, workflow logs and dump lines derived from an orders/lineitem star schema.

Each mapping is one SQL text that gives the same rows in Spark (:func:`rows`) and in any engine with standard SQL,
where the checks inline it as a common table expression. Tables are named by their bare names.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.functions.generated import apart

ACCOUNTING = """
WITH a AS (
 SELECT o_orderkey k, o_custkey, o_orderstatus, o_orderpriority,
   o_orderdate + INTERVAL '1' SECOND * ((o_orderkey*7919) % 86400) sub,
   (o_orderkey*31) % 7200 w, 10 + (o_orderkey*613) % 180000 el, 1 + o_orderkey % 16 cpus
 FROM orders),
b AS (SELECT *, CASE WHEN k % 97 = 0 THEN 0 ELSE el*cpus END cputime,
   CAST(floor(CASE WHEN k % 97 = 0 THEN 0 ELSE el*cpus*(k % 120) END / 100.0) AS BIGINT) t FROM a),
alloc AS (SELECT CAST(k AS STRING)||CASE WHEN k % 59 = 0 THEN '_2' ELSE '' END "JobID", 0 row_ord, replace(substr(CAST(sub AS STRING),1,19),' ','T') "Submit",
   replace(substr(CAST(sub + INTERVAL '1' SECOND * w AS STRING),1,19),' ','T') "Start",
   CASE WHEN k % 50 = 0 THEN 'Unknown' ELSE replace(substr(CAST(sub + INTERVAL '1' SECOND * (w+el) AS STRING),1,19),' ','T') END "End",
   el "ElapsedRaw", cpus "AllocCPUS", cputime "CPUTimeRAW",
   CASE WHEN k % 101 = 0 THEN '0' WHEN k % 43 = 0 THEN '2T' WHEN k % 47 = 0 THEN '1.5G' WHEN k % 53 = 0 AND k % 3 = 2 THEN '0K' WHEN k % 11 = 0 THEN CAST(512*(1+k%8) AS STRING)||'M' ELSE CAST(1+k%64 AS STRING)||'G' END "ReqMem",
   CAST(NULL AS STRING) "MaxRSS",
   CASE WHEN k % 29 = 0 AND k % 97 <> 0 THEN CAST(NULL AS STRING) WHEN t >= 86400 THEN CAST(CAST(floor(t/86400.0) AS BIGINT) AS STRING)||'-'||lpad(CAST(CAST(floor((t%86400)/3600.0) AS BIGINT) AS STRING),2,'0')||':'||lpad(CAST(CAST(floor((t%3600)/60.0) AS BIGINT) AS STRING),2,'0')||':'||lpad(CAST(CAST(t%60 AS BIGINT) AS STRING),2,'0')
        WHEN t >= 3600 THEN lpad(CAST(CAST(floor(t/3600.0) AS BIGINT) AS STRING),2,'0')||':'||lpad(CAST(CAST(floor((t%3600)/60.0) AS BIGINT) AS STRING),2,'0')||':'||lpad(CAST(CAST(t%60 AS BIGINT) AS STRING),2,'0')
        ELSE lpad(CAST(CAST(floor(t/60.0) AS BIGINT) AS STRING),2,'0')||':'||lpad(CAST(CAST(t%60 AS BIGINT) AS STRING),2,'0')||'.250' END "TotalCPU",
   CASE WHEN k % 19 = 0 THEN CAST(NULL AS STRING) WHEN k % 50 = 0 THEN 'RUNNING' WHEN k % 23 = 0 THEN 'CANCELLED by 1000' WHEN o_orderstatus='F' THEN 'COMPLETED' WHEN o_orderstatus='O' THEN 'FAILED' ELSE 'PREEMPTED' END "State",
   CASE WHEN k % 41 <> 0 THEN o_orderpriority END "QOS",
   CASE k % 3 WHEN 0 THEN 'rule_r'||CAST(k%7 AS STRING)||'_wildcards_s='||CAST(k AS STRING) WHEN 1 THEN 'rule_r'||CAST(k%7 AS STRING) END "Comment",
   CASE WHEN k % 31 <> 0 THEN 'run-'||CAST(k%10 AS STRING) END "JobName", 'u'||CAST(o_custkey AS STRING) "User",
   CASE WHEN k % 37 = 0 THEN CAST(NULL AS STRING) ELSE CASE WHEN el >= 86400 THEN CAST(CAST(floor(el/86400.0) AS BIGINT) AS STRING)||'-' ELSE '' END||lpad(CAST(CAST(floor((el%86400)/3600.0) AS BIGINT) AS STRING),2,'0')||':'||lpad(CAST(CAST(floor((el%3600)/60.0) AS BIGINT) AS STRING),2,'0')||':'||lpad(CAST(el%60 AS STRING),2,'0') END "Elapsed",
   'acct'||CAST(o_custkey%5 AS STRING) "Account", CASE WHEN k % 13 <> 0 THEN 'node'||CAST(k%8 AS STRING) END "NodeList"
 FROM b),
step AS (SELECT l_orderkey k, CAST(l_orderkey AS STRING)||CASE WHEN l_orderkey % 59 = 0 THEN '_2' ELSE '' END||CASE l_linenumber WHEN 6 THEN '.batch' WHEN 7 THEN '.extern' ELSE '.'||CAST(l_linenumber AS STRING) END "JobID",
   l_linenumber row_ord, max(l_quantity) q FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT * FROM alloc
UNION ALL
SELECT "JobID", row_ord, CAST(NULL AS STRING),CAST(NULL AS STRING),CAST(NULL AS STRING),CAST(NULL AS BIGINT),CAST(NULL AS BIGINT),CAST(NULL AS BIGINT),CAST(NULL AS STRING),
  CASE WHEN k % 53 = 0 AND k % 2 = 0 THEN '0K' WHEN CAST(q AS BIGINT) % 2 = 0 THEN CAST(CAST(q*97 AS BIGINT) AS STRING)||'M' ELSE CAST(CAST(q*40000 AS BIGINT) AS STRING)||'K' END,
  CASE WHEN row_ord <> 3 THEN '00:0'||CAST(row_ord AS STRING)||':30' END,
  CASE WHEN row_ord <> 6 THEN CASE row_ord % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE 'CANCELLED' END END,
  CAST(NULL AS STRING),CAST(NULL AS STRING),
  CASE row_ord WHEN 6 THEN 'batch' WHEN 7 THEN 'extern' WHEN 2 THEN CAST(NULL AS STRING) ELSE 'step-'||CAST(row_ord AS STRING) END,
  CAST(NULL AS STRING),'00:10:0'||CAST(row_ord AS STRING),CAST(NULL AS STRING),
  CASE WHEN row_ord % 2 = 1 THEN 'step-node'||CAST(row_ord AS STRING) END
FROM step
UNION ALL
SELECT CAST(k AS STRING)||'_10', 10, CAST(NULL AS STRING),CAST(NULL AS STRING),CAST(NULL AS STRING),el+5,cpus,CAST(NULL AS BIGINT),CAST(NULL AS STRING),
  CAST(NULL AS STRING),'00:10:10','TIMEOUT','array-qos','rule_r9_wildcards_late','run-late','late','00:00:00','late','late-node'
FROM b WHERE k % 59 = 0
"""

# The days whose dumps a job's rows come in: there is one dump per month, so calendars have gaps; some jobs are in two.
JOB_DAYS = """
SELECT CAST(o_orderkey AS STRING) job, CAST(date_trunc('month', o_orderdate) AS DATE) dt FROM orders
UNION ALL
SELECT CAST(o_orderkey AS STRING), CAST(date_trunc('month', o_orderdate) + INTERVAL '1' MONTH AS DATE) FROM orders WHERE o_orderkey % 23 = 0
"""

INPUT_SIZES = """
SELECT CAST(l_orderkey AS STRING) "slurm_jobid", CAST(l_orderkey AS STRING) "job_id",
  CAST('r' AS STRING)||CAST(l_orderkey % 7 AS STRING) "rule_name",
  CASE WHEN l_orderkey % 13 = 0 THEN 0 ELSE CAST(sum(l_quantity) AS BIGINT)*1048576 END "input_size_bytes",
  CAST('in/' AS STRING)||CAST(l_orderkey AS STRING) "inputs"
FROM lineitem GROUP BY l_orderkey
"""

LOG_LINES = """
WITH o AS (SELECT o_orderkey k, o_orderkey % 4 f, CAST(floor(o_orderkey/4.0) AS BIGINT) n, unnest(range(0,6)) i FROM orders),
p AS (SELECT f, unnest(range(0,3)) j FROM (SELECT unnest(range(0,4)) f) files)
SELECT '/w/p'||CAST(f AS STRING)||'/.snakemake/log/run.log' "file", CAST(10+n*6+i AS BIGINT) "line_no",
  CASE i WHEN 0 THEN '[block '||CAST(k AS STRING)||']'
    WHEN 1 THEN CASE WHEN k % 9 = 0 THEN 'localrule' ELSE 'rule' END||' r'||CAST(k%7 AS STRING)||':'
    WHEN 2 THEN '    input: in/'||CAST(k AS STRING)||'.a, in/'||CAST(k%100 AS STRING)||'.b'
    WHEN 3 THEN '    jobid: '||CAST(n AS STRING)
    WHEN 4 THEN CASE WHEN k % 10 = 0 THEN 'Nothing to be done' ELSE 'Job '||CAST(n AS STRING)||' has been submitted with SLURM jobid '||CAST(k AS STRING)||' (log: logs/'||CAST(k AS STRING)||'.log).' END
    ELSE '' END "value" FROM o
UNION ALL SELECT '/w/p'||CAST(f AS STRING)||'/.snakemake/log/run.log', CAST(j AS BIGINT), CASE j WHEN 2 THEN 'SLURM run ID: run-'||CAST(f AS STRING) ELSE 'preamble '||CAST(j AS STRING) END
FROM p
"""

# Sizes of the files the logs name; files of orders with status P do not exist.
MANIFEST = """
SELECT '/w/p'||CAST(o_orderkey % 4 AS STRING)||'/in/'||CAST(o_orderkey AS STRING)||'.a' "path", CAST(floor(o_totalprice) AS BIGINT) "length"
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL
SELECT '/w/p'||CAST(o_orderkey % 4 AS STRING)||'/in/'||CAST(o_orderkey % 100 AS STRING)||'.b', CAST(floor(max(o_totalprice)) AS BIGINT)
FROM orders GROUP BY o_orderkey % 4, o_orderkey % 100
"""

DUMP_COLUMNS = ["JobID", "State", "QOS", "Comment"]
DUMP_LINES = """
SELECT CASE WHEN o_orderkey % 37 = 0 THEN CAST(o_orderkey AS STRING)||'|'||o_orderstatus WHEN o_orderkey % 41 = 0 THEN CAST(o_orderkey AS STRING)||'|a|b|c|d'
 ELSE CAST(o_orderkey AS STRING)||'|'||o_orderstatus||'|'||CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'say "hi' ELSE o_orderpriority END||'|x' END "value" FROM orders
"""

# Dump lines in the three layouts a scheduler had: some lines have a field too many, some a number that is none.
LAYOUTS = (["JobID", "State", "ElapsedRaw"], ["JobID", "ElapsedRaw", "State", "QOS"], ["State", "JobID", "ElapsedRaw", "QOS", "Restarts"])
LAYOUT_LINES = """
WITH o AS (SELECT o_orderkey k, CAST(o_orderkey AS STRING) job, o_orderstatus st, o_orderpriority qos, CAST(o_orderkey % 5 AS STRING) again,
  CASE WHEN o_orderkey % 71 = 0 THEN 'unknown' WHEN o_orderkey % 73 = 0 THEN '' ELSE CAST(10 + (o_orderkey*613) % 180000 AS STRING) END el FROM orders)
SELECT CAST(k % 3 AS BIGINT) "era", CASE k % 3 WHEN 0 THEN job||'|'||st||'|'||el WHEN 1 THEN job||'|'||el||'|'||st||'|'||qos
  ELSE st||'|'||job||'|'||el||'|'||qos||'|'||again END||CASE WHEN k % 37 = 0 THEN '|extra' ELSE '' END "value" FROM o
"""

QUOTED_NAMES = (
    "era JobID Submit Start End ElapsedRaw AllocCPUS CPUTimeRAW ReqMem MaxRSS TotalCPU State QOS Comment JobName User "
    "Elapsed Account NodeList slurm_jobid job_id rule_name input_size_bytes inputs file line_no value path length"
).split()


TABLES = ("orders", "lineitem")


def rows(spark: SparkSession, sf_dir: str, mapping: str) -> DataFrame:
    """The mapping over the tables in ``sf_dir``, as a lazy frame."""
    # The two spellings the engines do not share: quoted names and rows from a list of numbers.
    text = re.sub(r"unnest\(range\(0,(\d+)\)\)", lambda m: f"explode(sequence(0,{int(m[1]) - 1}))", mapping)
    for name in QUOTED_NAMES:
        text = text.replace(f'"{name}"', f"`{name}`")
    tables = {}
    for name in TABLES:
        if f"FROM {name}" in text:
            text = text.replace(f"FROM {name}", "FROM {" + name + "}")
            tables[name] = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spark.sql(text, **tables)


def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, ACCOUNTING).drop("row_ord")
    return df.withColumns({**{n: df[n].cast("long") for n in ("ElapsedRaw", "AllocCPUS", "CPUTimeRAW")}, "JobID": apart("JobID")})


def accounting_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounting rows with the day (``dt``) of the dump they come in."""
    days = rows(spark, sf_dir, JOB_DAYS)
    df = accounting(spark, sf_dir)
    return df.join(days, F.regexp_extract("JobID", r"^(\d+)", 1) == days["job"]).drop("job")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, LOG_LINES)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, MANIFEST)


def input_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, INPUT_SIZES)


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, LAYOUT_LINES)


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, DUMP_LINES)
