"""What a box plot per group shows: quartiles, whiskers and outlying points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.operators.joining import join_on
from jobledger.operators.quantiles import frequencies, quantiles_of_frequencies

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
BOX = ["count", "min", "q1", "median", "q3", "max", "iqr", "whisker_low", "whisker_high", "outliers", "suspected_outliers"]


def _values_with_box(df: DataFrame, keys: list[str], value: str, method: str) -> DataFrame:
    """(keys, value, n) with the quartiles of the group and where each value lies.

    A value is an outlier when it lies more than 1.5 interquartile ranges outside the box, and a suspected one
    when it lies more than 3 outside.
    """
    freq = frequencies(df, keys, value)
    boxes = quantiles_of_frequencies(freq, keys, QUARTILES, method).selectExpr("*", "q3 - q1 AS iqr")
    return join_on(freq, boxes, keys).selectExpr(
        "*",
        "value < q1 - 1.5D * iqr OR value > q3 + 1.5D * iqr AS outlier",
        "value < 4 * q1 - 3 * q3 OR value > 4 * q3 - 3 * q1 AS suspected",
    )


def box_points(df: DataFrame, keys: list[str], value: str, method: str = "hazen") -> DataFrame:
    """The points drawn beside the boxes, one row per distinct value with its number of occurrences."""
    return _values_with_box(df, keys, value, method).where("outlier").select(*keys, "value", "n", "suspected")


def box_statistics(df: DataFrame, keys: list[str], value: str, method: str = "hazen") -> DataFrame:
    """One row per group with the columns of ``BOX``.

    Whiskers end at the furthest value that is no outlier, but never inside the box. ``hazen`` quartiles are the
    ones the reports draw, ``linear`` ones equal SQL ``percentile``.
    """
    aggregates = [f"max({c}) AS {c}" for c in ("count", "q1", "median", "q3", "iqr")] + [
        "min(value) AS min",
        "max(value) AS max",
        "least(max(q1), min(value) FILTER (WHERE NOT outlier)) AS whisker_low",
        "greatest(max(q3), max(value) FILTER (WHERE NOT outlier)) AS whisker_high",
        "coalesce(sum(n) FILTER (WHERE outlier), 0L) AS outliers",
        "coalesce(sum(n) FILTER (WHERE outlier AND suspected), 0L) AS suspected_outliers",
    ]
    values = _values_with_box(df, keys, value, method)
    return values.groupBy(*keys).agg(*[F.expr(a) for a in aggregates]).select(*keys, *BOX)
