"""Daily batch: one raw dump into the accounting database."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from jobledger.operators.lines import is_whole, rejection
from jobledger.schema import ACCOUNTING_COLUMNS, SEPARATOR
from jobledger.sources.dumps import by_layout, headers, lines_with_file, named_fields
from jobledger.sources.store import dump_name, write_dump


@dataclass(frozen=True)
class IngestResult:
    """Lines of the dump, lines without the right number of fields, and whole lines with an integer that is none."""

    lines: int
    dropped: int
    bad_numbers: int = 0


def ingest(
    spark: SparkSession,
    dump: str,
    database: str,
    day: str | dt.date,
    column_count: int | None = len(ACCOUNTING_COLUMNS),
    separator: str = SEPARATOR,
    names: list[str] | None = None,
    rejects: str | None = None,
) -> IngestResult:
    """Writes the whole lines of a dump as the partition of ``day`` and the dump's name; tells how many lines were dropped.

    One pass over the text and no shuffle: lines are counted by the job that writes them. The dump stays as it is. A
    rerun replaces what the dump gave before, also if no line is left. Columns are matched by each file's header;
    ``names`` gives the columns of a dump without header lines. ``column_count=None`` takes any header: columns that the
    scheduler added are stored as text, those it dropped are null when the database is read.

    A field that should be an integer but is not fails the load, unless there is a ``rejects`` folder: then such lines and the
    dropped ones are kept there (``value``, ``file``, ``reason``) by day and dump, and are replaced like the dump itself. They
    are read once more for that, if there are any.
    """
    lines = lines_with_file(spark, dump)
    found = {separator.join(names): []} if names else headers(spark, lines.inputFiles(), column_count, separator)
    if names and len(names) != column_count:
        raise ValueError(f"{len(names)} names for {column_count} columns")
    whole = by_layout(found, lambda columns: is_whole(len(columns), separator), separator)
    reason = by_layout(found, lambda columns: rejection(columns, separator), separator) if rejects else F.when(~whole, "columns")
    seen, judged = Observation(), lines.withColumn("reason", reason)
    counted = judged.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reason") == "columns").alias("dropped"), F.count("reason").alias("rejected"))
    name = spark.range(1).select(dump_name(F.lit(dump.rstrip("/")))).first()[0]
    write_dump(named_fields(counted.where("reason IS NULL").drop("reason"), found, separator), database, day, name)
    result = IngestResult(seen.get["lines"], seen.get["dropped"], seen.get["rejected"] - seen.get["dropped"])
    if rejects:
        kept = judged.where("reason IS NOT NULL").select("value", "file", "reason")
        write_dump(kept if result.dropped + result.bad_numbers else kept.limit(0), rejects, day, name)
    return result
