"""What is known of each job so far, in a form that can be merged: the roll-up of a history that grows day by day.

A number's state is its maximum. A text's state is its first non-null value in dump order together with its place in that
order, so that of two states the earlier text wins. Merging is associative and commutative: any split of the rows gives the
state of all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from jobledger.functions.generated import apart
from jobledger.operators.per_job import DAY, ORDER, add_cpu_efficiency, add_cpu_seconds, add_dump_order, add_memory_efficiency, sized_rows, with_expressions

# The job number, or empty for rows without one: a key that is never null.
KEY = "job_key"


def job_state(rows: DataFrame) -> DataFrame:
    """The state of each job in some accounting rows."""
    rows = with_expressions(add_dump_order(sized_rows(rows)), {KEY: "coalesce(JobRoot, '')"})
    aggregates = []
    for field in rows.schema.fields:
        name = f"`{field.name}`"
        if field.name in (KEY, ORDER, "JobRoot", DAY):
            continue
        state = f"min(CASE WHEN {name} IS NOT NULL THEN struct({ORDER} AS place, {name} AS text) END)" if isinstance(field.dataType, StringType) else f"max({name})"
        aggregates.append(F.expr(state).alias(field.name))
    return rows.groupBy(KEY).agg(*aggregates)


def merged(history: DataFrame, day: DataFrame) -> DataFrame:
    """Both states as one. A column that one of them does not have is null there."""
    other = day.withColumnsRenamed({c: f"_day_{c}" for c in day.columns})
    both = history.join(other, F.col(KEY) == F.col(f"_day_{KEY}"), "full_outer")
    cells = [apart(F.coalesce(KEY, f"_day_{KEY}")).alias(KEY)]
    for field in [f for f in history.schema if f.name != KEY] + [f for f in day.schema if f.name not in history.columns]:
        sides = [c for c, there in ((f"`{field.name}`", field.name in history.columns), (f"`_day_{field.name}`", field.name in day.columns)) if there]
        # Of texts the one in the earlier place; nulls lose.
        chosen = f"{'least' if isinstance(field.dataType, StructType) else 'greatest'}({', '.join(sides)})" if len(sides) == 2 else sides[0]
        cells.append(F.expr(chosen).alias(field.name))
    return both.select(*cells)


def jobs_of_state(state: DataFrame) -> DataFrame:
    """One row per job with its efficiency, as if all rows had been rolled up at once."""
    cells = [F.expr(f"nullif({KEY}, '')").alias("JobRoot")]
    cells += [(F.col(f"`{f.name}`.text") if isinstance(f.dataType, StructType) else F.col(f"`{f.name}`")).alias(f.name) for f in state.schema if f.name != KEY]
    return state.select(*cells).transform(add_memory_efficiency).transform(add_cpu_seconds).transform(add_cpu_efficiency)
