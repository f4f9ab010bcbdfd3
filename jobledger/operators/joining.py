"""Small join helper shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join where null keys match each other; the right keys are dropped.

    No broadcast hint: the static threshold and AQE broadcast a side when its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merge, with skewed partitions split.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.expr(" AND ".join(f"{k} <=> _right_{k}" for k in keys))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
