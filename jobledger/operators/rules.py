"""Statistics per workflow rule and the report tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.functions.arithmetic import max_number, min_number
from jobledger.functions.display import band_colour, table_number
from jobledger.operators.joining import join_on
from jobledger.operators.quantiles import Keep, quantiles_of_frequencies, unkept, unpivoted_frequencies
from jobledger.schema import BANDED_HEADINGS, RULE_HEADING, RULE_TABLES

KEY = "rule_name"
STATISTICS = ["mean", "median", "std", "min", "max"]
FIRST_TEXTS = ["QOS", "Account", "NodeList"]


def _text_statistics(runs: DataFrame) -> DataFrame:
    """Smallest and largest ``Elapsed`` text and the first non-null text of some columns, in job order.

    Texts have no fixed width, so aggregating them per rule directly would sort all jobs. They are first reduced to
    the distinct texts per rule by hash aggregation (a number is all that is kept per text).
    """
    columns = ["Elapsed", *FIRST_TEXTS]
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    texts = runs.selectExpr(KEY, "try_cast(JobRoot AS bigint) AS job", f"stack({len(columns)}, {pairs}) AS (field, text)")
    distinct = texts.where("text IS NOT NULL").groupBy(KEY, "field", "text").agg(F.min("job").alias("job"))
    # Job numbers order the rows; rows without one come last, equal ones by text.
    order = f"struct(coalesce(job, {2**63 - 1}L), text)"
    return distinct.groupBy(KEY).agg(
        F.expr("min(text) FILTER (WHERE field = 'Elapsed') AS Elapsed_min"),
        F.expr("max(text) FILTER (WHERE field = 'Elapsed') AS Elapsed_max"),
        *[F.expr(f"min_by(text, {order}) FILTER (WHERE field = '{c}') AS {c}") for c in FIRST_TEXTS],
    )


def _moments(measure: str) -> list[str]:
    whole = measure == "ElapsedRaw"
    return [
        f"avg({measure}) AS {measure}_mean",
        f"stddev_samp({measure}) AS {measure}_std",
        f"{f'min({measure})' if whole else min_number(measure)} AS {measure}_min",
        f"{f'max({measure})' if whole else max_number(measure)} AS {measure}_max",
    ]


def rule_statistics(runs: DataFrame, measures: list[str], texts: bool = True, keep: Keep = unkept) -> DataFrame:
    """Mean, median, deviation, minimum and maximum of each measure per rule, and some texts.

    ``runs`` is read for moments, medians and texts: pass a persisted or stored frame. ``keep`` (``Held.keep``) keeps the
    counted values of the medians, which are read twice.
    """
    moments = runs.groupBy(KEY).agg(*[F.expr(e) for m in measures for e in _moments(m)])
    counted = keep(unpivoted_frequencies(runs, [KEY], measures))
    medians = (
        quantiles_of_frequencies(counted, [KEY, "measure"], {"median": 0.5}, keep=keep)
        .groupBy(KEY)
        .agg(*[F.expr(f"max(median) FILTER (WHERE measure = '{m}') AS {m}_median") for m in measures])
    )
    joined, shown = join_on(moments, medians, [KEY], "left"), []
    if texts:
        joined, shown = join_on(joined, _text_statistics(runs), [KEY], "left"), ["Elapsed_min", "Elapsed_max", *FIRST_TEXTS]
    return joined.select(KEY, *[f"{m}_{s}" for m in measures for s in STATISTICS], *shown)


def distinct_rules(runs: DataFrame) -> DataFrame:
    """The rules in the order of the box plots (reverse alphabetical)."""
    return runs.select(KEY).distinct().orderBy(F.desc(KEY))


def report_table(statistics: DataFrame, measure: str) -> DataFrame:
    """One report table: the rule and five statistics under their report headings, sorted by rule."""
    headings = dict(zip(STATISTICS, RULE_TABLES[measure]))
    return statistics.orderBy(KEY).selectExpr(
        f"{KEY} AS `{RULE_HEADING}`", *[f"{measure}_{s} AS `{h}`" for s, h in headings.items()]
    )


def shown_table(table: DataFrame) -> DataFrame:
    """A report table as displayed: rounded, with a ``… (couleur)`` column beside each coloured heading."""
    cells = []
    for name in table.columns:
        cells.append(f"`{name}`" if name == RULE_HEADING else f"{table_number(f'`{name}`')} AS `{name}`")
        if name in BANDED_HEADINGS:
            cells.append(f"{band_colour(f'`{name}`')} AS `{name} (couleur)`")
    return table.selectExpr(*cells)
