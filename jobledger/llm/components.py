"""Connected components of a graph given as edges, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.common import settle


def star_edges(edges: DataFrame) -> DataFrame:
    """``u long, v long`` edges -> one edge (u, v) from each node to the smallest node v < u that it can reach.

    The smallest node itself has no row. Each round is written, so a lost executor costs one round at most; minima are
    combined before the shuffle, and a node with very many neighbours is a skewed join, which adaptive execution splits.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (state := now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()) != before:
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = settle(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        passed_on = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        now = settle(passed_on.union(least.select("u", F.col("least").alias("v"))).distinct(), "edges")
    return now
