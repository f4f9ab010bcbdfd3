"""Workflow logs: from lines to records (rule, job, input files) and input sizes.

Lines come as (``file``, ``chunk``, ``line_no``, ``value``). ``chunk`` numbers bounded runs of lines of a file in
order and ``line_no`` orders the lines of a chunk, so one huge log is worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.functions.parsing import matched

# The line shapes of a workflow log.
RECORD_START = "["
RULE_LINE = r"^rule\s+(\S+):"
INPUT_LINE = r"(?i)^\s*input\s*:\s*(.+)"
SUBMITTED_LINE = r"(?i)^Job\s+(\d+)\s+has\s+been\s+submitted\s+with\s+SLURM\s+jobid\s+(\d+)\s+\(log:\s+(.+)\)\.\z"
RUN_ID_MARK = "SLURM run ID: "
LOG_FOLDER = r"^(.*)/\.snakemake/log/[^/]+\z"
UNCLEAN_PATH = r"//|/\.{1,2}(/|\z)|/\z"

# What the lines above have in common at their start: one cheap test before the exact ones.
TELLING_LINE = r"(?i)^(?:\[|rule\s|\s*input\s*:|job\s+\d+\s+has\s)"

CHUNK_LINES = 65536
PART_LINES = 8192


def add_chunks(lines: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """Chunks for lines that are numbered per file."""
    return lines.selectExpr("*", f"line_no div {size} AS chunk")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines whose ``line_no`` counts from 0 in each file, from lines whose numbers grow by one within a chunk.

    Lines of chunks are counted, and the counts added up per file (a row per chunk); no line is sorted.
    """
    chunks = lines.groupBy("file", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("_first"))
    before = "coalesce(sum(n) OVER (PARTITION BY file ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before"
    numbered = lines.join(chunks.selectExpr("file", "chunk", "_first", before), ["file", "chunk"])
    return numbered.selectExpr("file", "chunk", "line_no - _first + _before AS line_no", "value")


def last_starts(lines: DataFrame) -> DataFrame:
    """(``file``, ``last_start``): the line that begins the last record of each file."""
    return lines.where(f"startswith(value, '{RECORD_START}')").groupBy("file").agg(F.max("line_no").alias("last_start"))


def _trimmed(text: str) -> str:
    return f"regexp_replace({text}, r'^\\s+|\\s+\\z', '')"


def marked_lines(lines: DataFrame) -> DataFrame:
    """Keeps the lines that start a record or say something about it, with what they say."""
    return lines.where(f"value RLIKE r'{TELLING_LINE}'").selectExpr(
        "file",
        "chunk",
        "line_no",
        f"CAST(startswith(value, '{RECORD_START}') AS int) AS starts",
        f"{matched('value', RULE_LINE, 1)} AS rule_name",
        f"{matched('value', INPUT_LINE, 1)} AS input_text",
        f"{matched('value', SUBMITTED_LINE, 1)} AS job_id",
        f"{matched('value', SUBMITTED_LINE, 2)} AS slurm_jobid",
    )


FIELDS = ["slurm_jobid", "job_id", "rule_name", "input_text"]
END_OF_PART = "following IS NULL"


def _so_far(column: str, place: str, window: str) -> str:
    """The last known value of a column up to a row, together with its place."""
    return f"max(CASE WHEN {column} IS NOT NULL THEN struct({place} AS place, {column} AS text) END) OVER ({window} UNBOUNDED PRECEDING) AS {column}"


def _since(column: str, start: str) -> str:
    """That value if the record that begins at ``start`` has it."""
    return f"CASE WHEN {start} IS NULL OR {column}.place >= {start} THEN {column}.text END AS {column}"


def log_records(lines: DataFrame) -> DataFrame:
    """One row per record that names a job: ``first_line, slurm_jobid, job_id, rule_name, inputs`` (last mention wins).

    A record runs from a line that starts one to the next such line; lines before the first belong to none. Lines
    are put in order part by part (some thousand lines of a chunk), and what a record says is known at its last line, so no
    window holds more than a part and lines are sorted once. Only what may go across a border, the open beginning and the
    last record of each part, is then looked at file by file: two rows per part. Parts are dealt to as many tasks as
    shuffles have partitions: their lines compress so well that partitions joined by their compressed size would be huge.
    """
    spark = lines.sparkSession
    part, place = ["file", "chunk", "part"], "line_no"
    marked = marked_lines(lines).withColumn("part", F.expr(f"{place} div {PART_LINES}"))
    dealt = marked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *part)
    in_part = f"PARTITION BY {', '.join(part)} ORDER BY {place}"
    begins = f"CASE WHEN starts = 1 THEN {place} END"
    pieces = (
        dealt.selectExpr(
            *part,
            f"max({begins}) OVER ({in_part} ROWS UNBOUNDED PRECEDING) AS first_line",
            f"lead(struct({begins} AS start)) OVER ({in_part}) AS following",
            *[_so_far(c, place, f"{in_part} ROWS") for c in FIELDS],
        )
        # The last line of each piece.
        .where(f"{END_OF_PART} OR (following.start IS NOT NULL AND NOT following.start <=> first_line)")
        .selectExpr(*part, "first_line", f"{END_OF_PART} AS ends_part", *[_since(c, "first_line") for c in FIELDS])
    )
    # A record inside a part is complete; pieces at a border are put together per file.
    inside = pieces.where("first_line IS NOT NULL AND NOT ends_part").drop("part", "ends_part")
    in_file = "PARTITION BY file ORDER BY chunk, part, first_line"
    here = "struct(chunk, part, first_line)"
    start = f"CASE WHEN first_line IS NOT NULL THEN {here} END"
    across = (
        pieces.where("first_line IS NULL OR ends_part")
        .selectExpr(
            "file",
            f"max({start}) OVER ({in_file} ROWS UNBOUNDED PRECEDING) AS owner",
            f"lead(struct({start} AS start)) OVER ({in_file}) AS following",
            *[_so_far(c, here, f"{in_file} ROWS") for c in FIELDS],
        )
        .where(f"owner IS NOT NULL AND ({END_OF_PART} OR following.start IS NOT NULL)")
        .selectExpr("file", "owner.chunk AS chunk", "owner.first_line AS first_line", *[_since(c, "owner") for c in FIELDS])
    )
    records = inside.unionByName(across).where("job_id IS NOT NULL")
    paths = f"transform(split({_trimmed('input_text')}, ','), p -> {_trimmed('p')})"
    return records.selectExpr(
        "file",
        "chunk",
        "first_line",
        "slurm_jobid",
        "job_id",
        "coalesce(rule_name, '') AS rule_name",
        f"coalesce({paths}, array()) AS inputs",
    )


def project_folder(file: str) -> str:
    """The folder a log's relative paths start from, or null when the log lies elsewhere."""
    return matched(file, LOG_FOLDER, 1)


def clean_path(path: str) -> str:
    """Lexical normalisation: empty and ``.`` steps go, ``..`` removes the step before. Links are not followed."""
    steps = f"""aggregate(split({path}, '/'), CAST(array() AS array<string>), (done, step) -> CASE
        WHEN step IN ('', '.') THEN done
        WHEN step = '..' THEN slice(done, 1, greatest(size(done) - 1, 0))
        ELSE concat(done, array(step)) END)"""
    return f"CASE WHEN {path} RLIKE r'{UNCLEAN_PATH}' THEN concat('/', array_join({steps}, '/')) ELSE {path} END"


def resolve_inputs(records: DataFrame, base_folder: str | None = None) -> DataFrame:
    """Input paths made absolute against the project folder (or ``base_folder`` for logs outside a project)."""
    based = records.withColumn("_folder", F.coalesce(F.expr(project_folder("file")), F.lit(base_folder)))
    absolute = "CASE WHEN startswith(p, '/') OR _folder IS NULL THEN p ELSE concat_ws('/', _folder, p) END"
    joined = based.withColumn("inputs", F.expr(f"transform(inputs, p -> {absolute})"))
    return joined.withColumn("inputs", F.expr(f"transform(inputs, p -> {clean_path('p')})")).drop("_folder")


def log_input_sizes(lines: DataFrame, manifest: DataFrame, base_folder: str | None = None) -> DataFrame:
    """The input-size table: per record the total length of its input files that exist in ``manifest``.

    ``manifest`` is (``path``, ``length``) with each path once. Paths of all records are joined at once; the record's
    own fields travel on its first path only, so the exploded rows stay small. A file used by most jobs makes one hot
    path: AQE splits its join partition, which it can because both sides come straight from their shuffle. Joined rows are
    dealt by record to as many tasks as shuffles have partitions and put in order there: a record's paths lie in different
    partitions of the join, so nothing is gained by putting them in order before.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    record, carried = ["file", "chunk", "first_line"], ["slurm_jobid", "job_id", "rule_name", "inputs"]
    records = resolve_inputs(log_records(lines), base_folder)
    exploded = records.selectExpr(
        *record, *carried[:3], "array_join(inputs, ',') AS inputs", "posexplode_outer(inputs) AS (place, path)"
    ).selectExpr(*record, "path", *[f"CASE WHEN coalesce(place, 0) = 0 THEN {c} END AS {c}" for c in carried])
    return (
        exploded.join(manifest, "path", "left")
        .select(*record, "length", *carried)
        .repartition(parts, *record)
        .groupBy(*record)
        .agg(F.expr("coalesce(sum(length), 0L) AS input_size_bytes"), *[F.max(c).alias(c) for c in carried])
        .select("slurm_jobid", "job_id", "rule_name", "input_size_bytes", "inputs")
    )


def run_ids(lines: DataFrame) -> DataFrame:
    """Per log the run id of its first line that names one."""
    named = lines.where(f"contains(value, '{RUN_ID_MARK}')")
    first = named.groupBy("file").agg(F.expr("min_by(value, struct(chunk, line_no)) AS value"))
    return first.selectExpr("file", f"substring({_trimmed('value')}, {len(RUN_ID_MARK) + 1}) AS run_id")
