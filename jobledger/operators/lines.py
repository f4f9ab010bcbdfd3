"""Raw dump lines: which ones are whole, and their fields by name and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.schema import ACCOUNTING_COLUMNS, SEPARATOR, column_type


def is_whole(column_count: int = len(ACCOUNTING_COLUMNS), separator: str = SEPARATOR) -> str:
    """Whether the separator occurs exactly ``column_count - 1`` times in ``value``."""
    return f"length(value) - length(replace(value, '{separator}', '')) = {(column_count - 1) * len(separator)}"


def whole_lines(lines: DataFrame, column_count: int = len(ACCOUNTING_COLUMNS), separator: str = SEPARATOR) -> DataFrame:
    return lines.where(is_whole(column_count, separator))


def line_counts(lines: DataFrame, column_count: int = len(ACCOUNTING_COLUMNS), separator: str = SEPARATOR) -> DataFrame:
    """How many lines there are, and how many of them are kept and dropped."""
    ok = is_whole(column_count, separator)
    counted = lines.groupBy().agg(F.expr("count(1) AS total"), F.expr(f"count_if({ok}) AS kept"))
    return counted.selectExpr("*", "total - kept AS dropped")


def _split(separator: str) -> str:
    # An escaped single character is split without a regular expression.
    pattern = f"\\{separator}" if len(separator) == 1 else f"\\Q{separator}\\E"
    return f"split(value, r'{pattern}', -1)"


def rejection(names: list[str], separator: str = SEPARATOR) -> str:
    """Why a line cannot be stored: ``columns`` (their number is wrong), ``number: NAME`` (the first integer that is none);
    null if it can, and for the header line."""
    whole = [i for i, name in enumerate(names) if column_type(name).simpleString() == "bigint"]
    wrong = [f"WHEN nullif(_p[{i}], '') IS NOT NULL AND try_cast(_p[{i}] AS bigint) IS NULL THEN 'number: {names[i]}'" for i in whole]
    # The fields are split once, in a list of one.
    numbers = f"transform(array({_split(separator)}), _p -> CASE {' '.join(wrong)} END)[0]" if wrong else "CAST(NULL AS string)"
    header = separator.join(names).replace("\\", "\\\\").replace("'", "\\'")
    return f"CASE WHEN value = '{header}' THEN NULL WHEN NOT ({is_whole(len(names), separator)}) THEN 'columns' ELSE {numbers} END"


def typed_fields(lines: DataFrame, names: list[str], separator: str = SEPARATOR) -> DataFrame:
    """Fields of whole lines as typed columns, in the order of ``names``; header lines are left out.

    Fields are split at every separator: quotes are ordinary characters. An empty field is null, and a field that
    should be an integer but is not fails the load. Columns of ``lines`` other than ``value`` are kept.
    """
    kept = [c for c in lines.columns if c != "value"]
    fields = [
        f"CAST(nullif(_parts[{i}], '') AS {column_type(name).simpleString()}) AS `{name}`" for i, name in enumerate(names)
    ]
    rows = lines.where(F.col("value") != separator.join(names))
    return rows.selectExpr(*kept, f"{_split(separator)} AS _parts").selectExpr(*kept, *fields)
