"""Exact grouped quantiles without bringing a group to one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. That is fine for small groups, but
here one group may hold a third of all jobs (the cluster line of the daily report always holds them all). So:

1. values are counted, (group, value) -> n, which spreads a hot group over all tasks;
2. the counts are added up in buckets of 0.024 % relative width, about 9 400 per factor of ten between the smallest
   and the largest value however many there are, and running totals over the buckets tell which hold the wanted ranks;
3. values may crowd in a bucket (percents near 100), so each wanted bucket is cut again, into 4 096 parts of equal
   width between its own smallest and largest value, and totals over the parts tell which hold the ranks;
4. only the distinct values in those parts are put in order. A part is at most 6e-8 of its values' size wide; values that
   are all closer to each other than that, as whole numbers and percents are not, would be put in order by one task.

The result is exact: buckets only decide which values are looked at, ranks are counted over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.operators.joining import join_on

STEPS = 4096
# What keeps a frame that is read several times, as ``Held.keep`` does.
Keep = Callable[[DataFrame], DataFrame]


def unkept(df: DataFrame) -> DataFrame:
    return df


def frequencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, ``value``, ``n``) for the non-null values of a column."""
    values = df.selectExpr(*keys, f"CAST({value} AS double) AS value").where("value IS NOT NULL")
    return values.groupBy(*keys, "value").count().withColumnRenamed("count", "n")


def unpivoted_frequencies(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """:func:`frequencies` of several columns at once, told apart by ``measure``."""
    pairs = ", ".join(f"'{m}', CAST({m} AS double)" for m in measures)
    values = df.selectExpr(*keys, f"stack({len(measures)}, {pairs}) AS (measure, value)").where("value IS NOT NULL")
    return values.groupBy(*keys, "measure", "value").count().withColumnRenamed("count", "n")


# log and floor never decrease, so buckets keep the order of the values; NaN sorts last as in Spark itself.
# 745 brings the logarithm of the smallest double above 0.
BUCKET = f"""
    CASE WHEN value = 0 THEN 0L
         WHEN isnan(value) THEN {2**40}L
         WHEN abs(value) = double('Infinity') THEN CAST(sign(value) AS bigint) * {2**39}L
         ELSE CAST(sign(value) AS bigint) * (floor((ln(abs(value)) + 745) * {STEPS}) + 1) END
"""

# Place of a value between the ends of its bucket.
PART = f"CASE WHEN high > low THEN least(floor((value - low) / (high - low) * {STEPS}), {STEPS - 1}) ELSE 0L END"


def _position(probability: float, method: str) -> str:
    """Zero-based, fractional rank of a quantile among ``total`` values."""
    if method == "linear":
        return f"({probability}D * (total - 1))"
    if method == "hazen":
        return f"least(greatest({probability}D * total - 0.5D, 0D), total - 1D)"
    raise ValueError(f"unknown quantile method {method!r}")


def _holds(rank: str) -> str:
    """Whether the values counted by (``before``, ``n``) have the rank."""
    return f"(before <= {rank} AND {rank} < before + n)"


def _counted_before(keys: list[str], order: str) -> str:
    return f"""coalesce(sum(n) OVER (PARTITION BY {", ".join(keys)} ORDER BY {order}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"""


def values_to_rank(freq: DataFrame, keys: list[str], wanted: str, keep: Keep = unkept) -> DataFrame:
    """The values near the wanted ranks, with ``n``, ``total`` and how many values lie before them and were left out.

    ``freq`` is read for the buckets and for the values in them; these are read twice, which ``keep`` saves. A group has a few
    wanted buckets, so a task makes a hash table of those it gets and need not sort the values.
    """
    group = ", ".join(keys)
    values = freq.selectExpr(*keys, "value", "n", f"{BUCKET} AS bucket")
    # ``skipped`` counts what lies before a wanted bucket and in no other wanted one, so that the totals below,
    # which run over the values of all wanted buckets, need only this added.
    buckets = (
        values.groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .selectExpr(
            "*",
            f"{_counted_before(keys, 'bucket')} AS before",
            f"sum(n) OVER (PARTITION BY {group} ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total",
        )
        .where(wanted)
        .selectExpr(*keys, "bucket", "low", "high", "total", f"before - {_counted_before(keys, 'bucket')} AS skipped")
    )
    found = join_on(values, buckets.hint("shuffle_hash"), [*keys, "bucket"])
    inside = keep(found.selectExpr(*keys, "value", "n", "bucket", f"{PART} AS part", "total", "skipped"))
    order = "bucket, part"
    parts = (
        inside.groupBy(*keys, "bucket", "part", "total", "skipped")
        .agg(F.sum("n").alias("n"))
        .selectExpr(*keys, "bucket", "part", "n", "total", f"skipped + {_counted_before(keys, order)} AS before")
        .where(wanted)
        .selectExpr(*keys, "bucket", "part", f"before - {_counted_before(keys, order)} AS skipped_more")
    )
    return join_on(inside, parts, [*keys, "bucket", "part"]).select(*keys, "value", "n", "total", "skipped_more")


def quantiles_of_frequencies(
    freq: DataFrame, keys: list[str], probabilities: dict[str, float], method: str = "linear", keep: Keep = unkept
) -> DataFrame:
    """One row per group: the keys, ``count`` and one column per entry of ``probabilities``.

    ``freq`` has the keys, ``value`` and ``n``; a value may come in several rows. ``linear`` interpolates at rank
    ``p (n-1)`` (SQL ``percentile``), ``hazen`` at ``p n - 1/2``, zero-based. With ``keep`` (``Held.keep``) ``freq`` is read
    twice, without it four times: Spark does not share the shuffles above a persisted frame.
    """
    positions = {name: _position(p, method) for name, p in probabilities.items()}
    wanted = " OR ".join(f"{_holds(f'floor({p})')} OR {_holds(f'ceil({p})')}" for p in positions.values())
    ranked = (
        values_to_rank(freq, keys, wanted, keep)
        .selectExpr(*keys, "value", "n", "total", f"skipped_more + {_counted_before(keys, 'value')} AS before")
        .where(wanted)
    )
    ends = [
        f"max(value) FILTER (WHERE {_holds(f'{end}({position})')}) AS {name}_{end}"
        for name, position in positions.items()
        for end in ("floor", "ceil")
    ]
    interpolated = [
        f"""CASE WHEN {name}_floor = {name}_ceil THEN {name}_floor
            ELSE {name}_floor + ({name}_ceil - {name}_floor) * ({position} - floor({position})) END AS {name}"""
        for name, position in positions.items()
    ]
    picked = ranked.groupBy(*keys).agg(*[F.expr(e) for e in ["max(total) AS total", *ends]])
    return picked.selectExpr(*keys, "total AS count", *interpolated)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], method: str = "linear") -> DataFrame:
    return quantiles_of_frequencies(frequencies(df, keys, value), keys, probabilities, method)
