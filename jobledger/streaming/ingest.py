"""Incremental ingest of a folder that daily dumps are dropped into."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobledger.operators.lines import is_whole
from jobledger.schema import ACCOUNTING_COLUMNS, SEPARATOR
from jobledger.sources.dumps import by_layout, headers, named_fields
from jobledger.sources.store import day_of_path, dump_name, write_dumps


def dump_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Lines of the dumps in ``folder`` with their file, the day named in its path, and the dump's name."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    file = F.col("_metadata.file_path")
    return lines.select("value", file.alias("file"), day_of_path(file).alias("dt"), dump_name(file).alias("dump"))


def once_only(lines: DataFrame, within: str) -> DataFrame:
    """Lines that a day has already had within that time go, whatever file they come in.

    The state holds a hash of each line of the last days, by time of arrival, so that no late dump is ever left out.
    """
    arrived = lines.withColumns({"_arrived": F.current_timestamp(), "_line": F.unhex(F.md5(F.col("value").cast("binary")))})
    return arrived.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["dt", "_line"]).drop("_arrived", "_line")


def store_lines(lines: DataFrame, database: str, columns: list[str] | None, with_header: bool, separator: str = SEPARATOR) -> None:
    """The transforms of the batch ingest on the lines of some files. Jobs are not rolled up: later days may add rows."""
    # One row per file of the batch, of which there are at most as many as a trigger takes.
    files = lines.select("file", "dt", "dump").distinct().collect()
    if undated := [r["file"] for r in files if r["dt"] is None]:
        raise ValueError(f"no day in the path of {undated[:3]}")
    if not files:
        return
    names = sorted(r["file"] for r in files)
    found = headers(lines.sparkSession, names, columns, separator) if with_header else {separator.join(columns): names}
    whole = by_layout(found, lambda header: is_whole(len(header), separator), separator)
    write_dumps(named_fields(lines.where(whole), found, separator), database, [(r["dt"], r["dump"]) for r in files])


def ingest_new_dumps(
    spark: SparkSession,
    folder: str,
    database: str,
    checkpoint: str,
    names: list[str] | None = None,
    separator: str = SEPARATOR,
    columns: list[str] | None = ACCOUNTING_COLUMNS,
    once_within: str | None = None,
) -> StreamingQuery:
    """Adds every dump that has not been ingested yet to the database, then stops.

    The checkpoint remembers the ingested files, so the daily job can simply be started again after a failure; a batch
    that is run again replaces what it had written. Each file's columns are matched by its header, which must hold
    ``columns`` (None: any columns); ``names`` gives the columns of dumps without header lines. A dump without a day in its
    path fails.

    ``once_within`` (such as ``30 days``) is for dumps that may be delivered again under another name: a line that its day
    has had within that time is stored once.
    """
    lines = dump_stream(spark, folder)
    if once_within:
        lines = once_only(lines, once_within)

    def store(batch: DataFrame, _: int) -> None:
        # A batch is read twice; what depends on state is kept for that.
        held = batch.persist(StorageLevel.MEMORY_AND_DISK) if once_within else batch
        store_lines(held, database, names or columns, names is None, separator)
        if once_within:
            held.unpersist()

    return (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
