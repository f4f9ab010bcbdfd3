"""Shards of equal bytes in key order: histogram sort (Kale and Krishnan 1993).

Rows have a sort key. For each of the n - 1 boundaries between shards there is a range of keys in which it must lie. A
round cuts each range into ``PROBES`` parts and counts, over all partitions, the exact bytes below every cut; the part
that holds the wanted byte is the next range. A boundary is settled as soon as a cut is within the tolerance. Then rows
are exchanged once, by ranges of the key, and numbered within their shard.

Scale. A round is one aggregation of a slim table with map-side combining, at most ``PROBES`` rows per boundary come
back. The key ends in hashes of the document's id and of the row's number in the scan, so a group of equal texts, however
large and whatever its ids, can be cut by a boundary; and a range shrinks to the keys that are really in it, so such a group
takes a few rounds more, not many. The exchange is Spark's range
partitioning into as many partitions as the session has for shuffles, not one per shard: numbers within a shard come
from the place in the partition and the counts of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.llm.common import doc_key, settle

PROBES = 256
KEY = "decimal(38,0)"


def text_then_id(text: str = "text", doc_id: str = "doc_id") -> Column:
    """Sort key: 60 bits of the text's hash (equal texts are neighbours), 31 of the id's, 33 of the row's number.

    The number tells rows apart that share text and id; it comes from the scan, so write the rows with their keys before they are read twice.
    """
    head = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 4).cast("decimal(19,0)")
    own = F.shiftleft(F.shiftrightunsigned(F.xxhash64(doc_key(doc_id)), 33), 32)
    number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 32)
    tail = own.cast("decimal(20,0)") * 2 + number.cast("decimal(20,0)")
    return (head * F.lit(str(1 << 64)).cast("decimal(20,0)") + tail).cast(KEY)


def _number(value: int) -> Column:
    return F.lit(str(value)).cast(KEY)


def boundaries(rows: DataFrame, shards: int, tolerance: float, key: str = "key", size: str = "size") -> list[int]:
    """Keys at which shards 1, 2, ... begin. ``tolerance`` is a share of a shard's bytes."""
    rows = rows.select(F.col(key).alias("k"), F.col(size).alias("n"))
    total, low, high = rows.agg(F.sum("n"), F.min("k"), F.max("k")).first()
    if total is None:
        return []
    wanted = {i: total * i / shards for i in range(1, shards)}
    slack = tolerance * total / shards
    found: dict[int, int] = {}
    ranges = {i: (int(low), int(high) + 1, 0) for i in wanted}
    while ranges:
        cuts = sorted(set(ranges.values()))
        step = [-(-(b - a) // PROBES) for a, b, _ in cuts]
        chosen = None
        for j, (a, b, _) in enumerate(cuts):
            here = (F.col("k") >= _number(a)) & (F.col("k") < _number(b))
            part = F.struct(F.lit(j).alias("range"), F.floor((F.col("k") - _number(a)) / _number(step[j])).cast("int").alias("part"))
            chosen = F.when(here, part) if chosen is None else chosen.when(here, part)
        counted = rows.withColumn("at", chosen).where("at IS NOT NULL").groupBy("at.range", "at.part")
        parts: dict[int, list] = {}
        for r in counted.agg(F.sum("n").alias("n"), F.min("k").alias("first"), F.max("k").alias("last")).collect():
            parts.setdefault(r["range"], []).append((int(r["first"]), int(r["last"]), r["n"]))
        number, still = {c: j for j, c in enumerate(cuts)}, {}
        for i, (a, b, below) in ranges.items():
            for first, last, n in sorted(parts[number[(a, b, below)]]):
                if below + n >= wanted[i]:
                    break
                below += n
            least, most = wanted[i] - below, below + n - wanted[i]
            if min(least, most) <= slack or first == last:
                found[i] = first if least <= most else last + 1
            else:
                still[i] = (first, last + 1, below)
        ranges = still
    return [found[i] for i in sorted(found)]


def shard_by_bytes(rows: DataFrame, shards: int = 16, tolerance: float = 0.001, key: str = "key", size: str = "size") -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard, in key order).

    ``key`` is a ``decimal(38,0)`` without nulls, ``size`` a number of bytes above 0. Shards hold equal bytes up to the
    tolerance, or as near as whole rows allow. Rows with equal keys stay together in any order, so keys should end in something
    that tells rows apart, as :func:`text_then_id` does. A row as large as a shard or larger has that shard nearly to itself; the
    shards beside it may be empty. An empty table has no shards.
    """
    begins = boundaries(settle(rows.select(key, size), "keys"), shards, tolerance, key, size)
    shard = sum((F.when(F.col(key) >= _number(b), 1).otherwise(0) for b in begins), F.lit(0)).cast("int")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("shard", shard).repartitionByRange(partitions, key).sortWithinPartitions(key)
    # The number counts rows within a partition, the upper bits are the partition; written, so that it stays as it is.
    dealt = settle(dealt.withColumn("__at", F.monotonically_increasing_id()), "shards")
    partition = F.shiftright("__at", 33).cast("int")
    dealt = dealt.withColumn("__partition", partition)
    pieces = dealt.groupBy("__partition", "shard").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__partition").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    placed = dealt.join(pieces, ["__partition", "shard"])
    slot = (F.col("__at") - F.col("__first") + F.col("__before")).cast("long")
    return placed.withColumn("slot", slot).select(*[f"`{c}`" for c in rows.columns if c not in ("shard", "slot")], "shard", "slot")
