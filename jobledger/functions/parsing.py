"""Parsing of accounting fields: job ids, memory sizes, CPU times, timestamps, rule comments."""

from __future__ import annotations

import functools

# The shapes of the accounting fields.
JOB_ROOT = r"^(\d+)"
STEP_SUFFIX = r"^\.\d+\z"
OTHER_SUFFIX = r"^\.."
ARRAY_TASK = r"^\d+_(\d+)"
STEP_PART = r"^\d+(?:_\d+)?\.(.+)"
SIZE = r"(\d+)([KMGT])"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\z"
CPU_DAYS = r"^\d+-\d+:\d+:\d+\z"
CPU_HOURS = r"^\d+:\d+:\d+\z"
CPU_MINUTES = r"^\d+:\d+\.\d+\z"
RULE_WITH_WILDCARDS = r"^rule_(.+?)_wildcards_(.+)"
RULE_ALONE = r"^rule_(.+)\z"

# Bytes per unit. Terabytes are recognised as a unit but have no factor, so they give null.
UNIT_BYTES = {"K": 2**10, "M": 2**20, "G": 2**30}
GIGABYTE = 2**30


def matched(text: str, pattern: str, group: int) -> str:
    """The regex group, or null (not an empty string) when there is no match."""
    return f"nullif(regexp_extract({text}, r'{pattern}', {group}), '')"


def job_root(job_id: str) -> str:
    return matched(job_id, JOB_ROOT, 1)


def job_suffix(job_id: str, root: str) -> str:
    return f"substring({job_id}, length({root}) + 1)"


def job_kind(job_id: str, root: str | None = None, suffix: str | None = None) -> str:
    """What a row of the dump describes, told by what follows the job number; ``root`` and ``suffix`` are columns that have them."""
    root = root or job_root(job_id)
    suffix = suffix or job_suffix(job_id, root)
    return f"""CASE WHEN {root} IS NULL OR {suffix} = '' THEN 'allocation' WHEN {suffix} = '.batch' THEN 'batch'
        WHEN {suffix} = '.extern' THEN 'extern' WHEN {suffix} RLIKE r'{STEP_SUFFIX}' THEN 'step'
        WHEN {suffix} RLIKE r'{OTHER_SUFFIX}' THEN 'unknown' ELSE 'allocation' END"""


def dump_order(job_id: str, name: str, day: str | None = None) -> list[dict[str, str]]:
    """Columns, step by step, that end with ``name``: what puts the rows of a job in dump order.

    The key is two numbers, as every text column keeps a copy of it. First the day of the dump (if given) and the number
    of the array task; then, within a task or job, allocation, batch, extern, steps by number, and anything else by a hash
    of the job id. Ids of digits, or of digits and the digits of an array task, before the first dot are the rule; they
    need no regular expression. Each step is read more than once by the next: written as one expression, it would be
    repeated so often that the JVM no longer compiles the code made from it.
    """
    head, shape, plain, part, task, rank = (f"{name}_{c}" for c in ("head", "shape", "plain", "part", "task", "rank"))
    array_task = f"CASE WHEN {shape} = '_' THEN substring_index({head}, '_', -1) END"
    odd_task = f"regexp_extract({job_id}, r'{ARRAY_TASK}', 1)"
    number = f"coalesce(try_cast(CASE WHEN {plain} THEN {array_task} ELSE {odd_task} END AS int) + 1L, 0L)"
    within = f"CASE {rank} WHEN 3 THEN CAST({part} AS bigint) WHEN 4 THEN shiftrightunsigned(xxhash64({job_id}), 8) ELSE 0L END"
    first = task if day is None else f"shiftleft(CAST(unix_date({day}) AS bigint), 32) + {task}"
    return [
        {head: f"substring_index({job_id}, '.', 1)"},
        {shape: f"translate({head}, '0123456789', '')"},
        {plain: f"CASE {shape} WHEN '' THEN {head} <> '' WHEN '_' THEN NOT startswith({head}, '_') AND NOT endswith({head}, '_') ELSE false END"},
        {
            part: f"CASE WHEN {plain} THEN substring({job_id}, length({head}) + 2) ELSE regexp_extract({job_id}, r'{STEP_PART}', 1) END",
            task: number,
        },
        {
            rank: f"""CASE WHEN NOT {plain} AND {job_root(job_id)} IS NULL THEN 4 WHEN {part} = '' THEN 0 WHEN {part} = 'batch' THEN 1
                WHEN {part} = 'extern' THEN 2 WHEN try_cast({part} AS int) >= 0 THEN 3 ELSE 4 END"""
        },
        {name: f"struct({first} AS k0, shiftleft(CAST({rank} AS bigint), 57) + coalesce({within}, 0L) AS k1)"},
    ]


def size_digits(text: str) -> str:
    return matched(text, SIZE, 1)


def size_unit(text: str) -> str:
    return matched(text, SIZE, 2)


def unit_bytes(digits: str, unit: str) -> str:
    factors = " ".join(f"WHEN '{name}' THEN {size}L" for name, size in UNIT_BYTES.items())
    return f"try_multiply(try_cast({digits} AS bigint), CASE {unit} {factors} END)"


def size_match(text: str) -> str:
    """The digits and the unit of a size; empty if it has none."""
    return f"regexp_extract({text}, r'{SIZE}', 0)"


def matched_bytes(match: str) -> str:
    """What :func:`size_match` found, in bytes."""
    return unit_bytes(f"substring({match}, 1, length({match}) - 1)", f"right({match}, 1)")


def size_bytes(text: str) -> str:
    """``12K``/``3M``/``2G`` in bytes; anything else is null."""
    return matched_bytes(size_match(text))


def gigabytes(size: str) -> str:
    return f"{size} / {GIGABYTE}D"


def cpu_seconds(text: str) -> str:
    """``D-HH:MM:SS``, ``HH:MM:SS`` or ``MM:SS.frac`` in whole seconds, 0 for any other text and for null.

    A number of seconds beyond 64 bits is null, like a size beyond them.
    """

    def total(*seconds: int) -> str:
        parts = [f"try_multiply({size}L, try_cast(get(split({text}, '[-:.]'), {i}) AS bigint))" for i, size in enumerate(seconds)]
        return functools.reduce(lambda a, b: f"try_add({a}, {b})", parts)

    return f"""CASE WHEN {text} RLIKE r'{CPU_DAYS}' THEN {total(86400, 3600, 60, 1)}
        WHEN {text} RLIKE r'{CPU_HOURS}' THEN {total(3600, 60, 1)}
        WHEN {text} RLIKE r'{CPU_MINUTES}' THEN {total(60, 1)} ELSE 0L END"""


def rule_name(comment: str) -> str:
    return f"coalesce({matched(comment, RULE_WITH_WILDCARDS, 1)}, {matched(comment, RULE_ALONE, 1)})"


def wildcards(comment: str) -> str:
    return matched(comment, RULE_WITH_WILDCARDS, 2)


def timestamp(text: str) -> str:
    """Local time without a zone; ``Unknown`` and every other text that is not a full timestamp is null."""
    return f"CASE WHEN {text} RLIKE r'{TIMESTAMP}' THEN try_cast({text} AS timestamp_ntz) END"


def seconds_between(start: str, end: str) -> str:
    # Subtracting zone-less timestamps never consults the session zone, unlike timestampdiff.
    return f"CAST(CAST({end} - {start} AS interval second) AS bigint)"
