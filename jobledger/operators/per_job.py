"""From accounting rows (allocation and steps) to one row per job with its efficiency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from jobledger.functions import parsing
from jobledger.functions.arithmetic import ieee_divide
from jobledger.schema import ACCOUNTING_SCHEMA, JOB_REPORT_COLUMNS, JOB_REPORT_DERIVED

ORDER = "_order"
DAY = "dt"


def with_expressions(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in expressions.items()})


def add_job_kind(df: DataFrame) -> DataFrame:
    """Adds ``JobRoot`` and ``JobInfoType``."""
    rooted = with_expressions(df, {"JobRoot": parsing.job_root("JobID")})
    told = with_expressions(rooted, {"_suffix": parsing.job_suffix("JobID", "JobRoot")})
    return with_expressions(told, {"JobInfoType": parsing.job_kind("JobID", "JobRoot", "_suffix")}).drop("_suffix")


def add_size_unit(df: DataFrame, *names: str) -> DataFrame:
    """Splits sizes: the digits replace the column, the unit goes to ``{name}_unit``."""
    units = {f"{name}_unit": parsing.size_unit(name) for name in names}
    return with_expressions(df, {**units, **{name: parsing.size_digits(name) for name in names}})


def size_to_bytes(df: DataFrame, *names: str) -> DataFrame:
    """Turns the digits and unit of :func:`add_size_unit` into bytes and drops the unit."""
    sizes = {name: parsing.unit_bytes(name, f"{name}_unit") for name in names}
    return with_expressions(df, sizes).drop(*[f"{name}_unit" for name in names])


def bytes_to_gigabytes(df: DataFrame, *names: str, keep_original: bool = False) -> DataFrame:
    return with_expressions(df, {f"{n}_G" if keep_original else n: parsing.gigabytes(n) for n in names})


def add_cpu_seconds(df: DataFrame) -> DataFrame:
    return with_expressions(df, {"TotalCPU_seconds": parsing.cpu_seconds("TotalCPU")})


def add_rule_name(df: DataFrame) -> DataFrame:
    """Adds ``rule_name`` and ``wildcards`` parsed from ``Comment``."""
    return with_expressions(df, {"rule_name": parsing.rule_name("Comment"), "wildcards": parsing.wildcards("Comment")})


def add_dump_order(df: DataFrame, keys: list[str] | str = "JobRoot") -> DataFrame:
    """Adds the place in dump order. A job in the dumps of several days takes its texts from the first, unless days are kept apart."""
    keys = [keys] if isinstance(keys, str) else keys
    steps = parsing.dump_order("JobID", ORDER, DAY if DAY in df.columns and DAY not in keys else None)
    return reduce(with_expressions, steps, df).drop(*[name for step in steps[:-1] for name in step])


def aggregate_per_job(df: DataFrame, keys: list[str] | str = "JobRoot", order: str | None = None) -> DataFrame:
    """One row per job over *all* columns: numbers take the maximum, texts the first non-null in dump order.

    The order is taken from the data (``order`` is SQL text, by default day of the dump if rows have one, array
    task, kind of row, step number) so that the answer does not depend on how Spark split the input. Columns nobody reads
    afterwards are pruned, together with their aggregates. Rows of a job combine map-side, so a huge job (or all rows
    without a job number) reaches the shuffle as one row per task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    # A text and its place are one buffer: Spark copies buffers for every row, and with ``min_by`` a text would have two.
    place = f"{ORDER} AS place" if order else f"{ORDER}.k0, {ORDER}.k1"
    aggregates = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if field.name in (*keys, DAY):
            continue
        if isinstance(field.dataType, (LongType, DoubleType)):
            aggregates.append(F.expr(f"max({name})").alias(field.name))
        elif isinstance(field.dataType, StringType):
            first = f"min(CASE WHEN {name} IS NOT NULL AND {ORDER} IS NOT NULL THEN struct({place}, {name} AS text) END).text"
            aggregates.append(F.expr(first).alias(field.name))
        else:
            raise TypeError(f"{field.name} has type {field.dataType.simpleString()}, expected bigint, double or string")
    ordered = with_expressions(df, {ORDER: order}) if order else add_dump_order(df, keys)
    return ordered.groupBy(*keys).agg(*aggregates)


def add_memory_efficiency(df: DataFrame) -> DataFrame:
    ratio = ieee_divide("MaxRSS", "ReqMem")
    return with_expressions(df, {"MemEfficiencyRatio": ratio, "MemEfficiencyPercent": f"({ratio}) * 100"})


def add_cpu_efficiency(df: DataFrame) -> DataFrame:
    """Adds ``CPUEfficiencyPercent``; 0 of 0 seconds is 0."""
    ratio = ieee_divide("TotalCPU_seconds", "CPUTimeRAW")
    return with_expressions(df, {"CPUEfficiencyPercent": f"nanvl({ratio}, 0D) * 100"})


def sized_rows(df: DataFrame) -> DataFrame:
    """Accounting rows with what they describe and their sizes as numbers: what the roll-up reads."""
    kinds = add_job_kind(df)
    # The three size steps above at once, with one match a size.
    names = ("MaxRSS", "ReqMem")
    matches = with_expressions(kinds, {f"_{name}": parsing.size_match(name) for name in names})
    sizes = with_expressions(matches, {name: parsing.matched_bytes(f"_{name}") for name in names}).drop(*[f"_{name}" for name in names])
    return bytes_to_gigabytes(sizes, *names, keep_original=True)


def job_efficiency(df: DataFrame, keys: list[str] | str = "JobRoot", order: str | None = None) -> DataFrame:
    """What share of the requested memory and CPU time each job used."""
    jobs = aggregate_per_job(sized_rows(df), keys, order)
    return jobs.transform(add_memory_efficiency).transform(add_cpu_seconds).transform(add_cpu_efficiency)


def conform(df: DataFrame) -> DataFrame:
    """The rows with their day, if any, and all accounting columns in dump order; missing ones are null."""
    present = set(df.columns)
    return df.selectExpr(
        *[c for c in df.columns if c == DAY],
        *[f"CAST({f.name if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}" for f in ACCOUNTING_SCHEMA]
    )


def job_report(jobs: DataFrame) -> DataFrame:
    """The columns of the per-job efficiency export."""
    return jobs.select(*JOB_REPORT_COLUMNS, *JOB_REPORT_DERIVED)
