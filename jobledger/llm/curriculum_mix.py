"""Mixing sources to target weights with a time-varying curriculum.

Targets. Sources share a budget by weight; none gets more than ``most_repeats`` times its size, and what it cannot take
is shared again. Sorted by cap over weight, the capped sources are a prefix, so running sums over the sources give the
fixed point at once.

Positions. A source's weight changes over the training time t from 0 to 1 along straight lines between knots. Its integral
is the source's cumulative token demand; a document whose words begin x of the way through the source's target is due
when the demand reaches x, so its training position is the inverse of the integral at x (a quadratic per segment). Passes
beyond the first go on where the source ended. Documents are range-sorted by position.

Scale. The words before a document in its source are a running sum in the order of a hash of the id, then of a hash of the
text, so that reruns agree also where ids are null or repeated. A source may hold a third of all rows, so each source is cut
into buckets by ranges of the first hash; bucket totals are summed first, and a window never sees more than one bucket. The
number of buckets follows the number of rows and does not change any result. A bucket with far more rows than others (one
id has very many) is cut further by the second hash and, where that is equal too, by the number of the row in the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.llm.common import WORD

# Buckets are the number of rows to this power: 50 000 rows give 660, 30 billion give two million.
BUCKET_POWER = 0.6
# A bucket with more than this part of all rows is cut further; so there are at most as many of them.
CROWDED = 4096
CROWDED_ROWS = 20_000
# Weights at the knots t = 0, 1/2 and 1, for sources in order, repeating: early, even, late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: str = "text") -> Column:
    """Orders rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _buckets(rows: DataFrame, n: int) -> Column:
    """A number for each row's bucket, which never falls in the order of ``__place`` and ``__tie``.

    In a crowded bucket the rows of its most frequent id are cut by their ties and, if these are equal, by row number.
    """
    prefix = F.conv(F.substring("__place", 1, 8), 16, 10).cast("long")
    bucket = F.floor(prefix * max(1, round(n**BUCKET_POWER)) / F.lit(1 << 32)).cast("long")
    whole = bucket * (1 << 41)
    named = F.concat_ws(":", bucket.cast("string"), "__named")
    counted = rows.groupBy(named.alias("bucket")).agg(F.count("*").alias("n"))
    crowded = [r["bucket"] for r in counted.where(F.col("n") > max(CROWDED_ROWS, n // CROWDED)).collect()]  # at most CROWDED
    if not crowded:
        return whole
    places = rows.where(named.isin(crowded)).groupBy(named.alias("bucket"), "__place").count()
    hot = dict(places.groupBy("bucket").agg(F.max_by("__place", "count")).collect())
    of = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[named]
    tie = F.shiftrightunsigned(F.col("__tie").bitwiseXOR(F.lit(-(1 << 63))), 32)
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(128))
    part = F.when(F.col("__place") == of, 1 + tie * 128 + spread).when(F.col("__place") > of, F.lit(1 << 40))
    return whole + F.coalesce(F.when(named.isin(crowded), part), F.lit(0))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most_repeats: int) -> DataFrame:
    """``source, source_size`` -> also ``source_rank`` and ``target``. One row per source; null is the last source."""
    ranked = sizes.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * most_repeats})
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everyone) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    leveled = leveled.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "source_rank", "level"))).over(everyone)["level"]
    return leveled.select(
        "source", "source_size", "source_rank", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(first * F.col("weight")).alias("target")
    )


def demand_time(x: Column, rank: Column, schedules: Sequence[Sequence[float]]) -> Column:
    """The time at which the integral of a source's schedule reaches the share ``x`` of its whole."""
    cases = None
    for shape, knots in enumerate(schedules):
        width = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * width for a, b in zip(knots, knots[1:])]
        whole, done = sum(areas), 0.0
        for k, area in enumerate(areas):
            left = (x - F.lit(done / whole)) * whole
            bend = (knots[k + 1] - knots[k]) / (2 * width)
            time = F.lit(k * width) + 2 * left / (F.lit(float(knots[k])) + F.sqrt(F.lit(float(knots[k]) ** 2) + 4 * bend * left))
            done += area
            here = (rank % len(schedules) == shape) & ((x < done / whole) if k + 1 < len(areas) else F.lit(True))
            cases = F.when(here, time) if cases is None else cases.when(here, time)
    return cases


def mix(
    docs: DataFrame,
    size: Column,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most_repeats: int = 2,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    tie: Column | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``passes`` and ``taken``.

    ``passes`` has, for each time the document is taken, how many words and its training position; ``taken`` is the sum
    of words. All of a source's words are used before any is repeated, and the document at the end of the target is taken
    in part, so that a source gives its target rounded down. ``tie`` (a long) orders rows with equal ids; by default a hash of
    the column ``text``, if there is one. Weights and schedules are positive. Columns whose names begin
    with two underscores are reserved and dropped. Documents without words
    (null, empty, blank texts) have no passes; null sources are one source; repeated rows are rows of their own.
    """
    if tie is None:
        tie = text_hash() if "text" in docs.columns else F.lit(0).cast("long")
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.withColumns({"size": size, "__place": place, "__tie": tie, "__named": named})
    # The totals need neither texts nor order.
    n = docs.count()
    rows = rows.withColumn("__bucket", _buckets(rows, n))
    totals = rows.groupBy("__named", "__bucket").agg(F.sum("size").alias("__sum"), F.first("source").alias("source"))
    targets = source_targets(totals.groupBy("__named").agg(F.first("source").alias("source"), F.sum("__sum").alias("source_size")).drop("__named"), weights, share, most_repeats)
    targets = targets.withColumn("__named", named).drop("source")
    earlier = Window.partitionBy("__named").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__named", "__bucket", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier")).join(targets.withColumnsRenamed({c: f"__{c}" for c in ("source_size", "source_rank", "target")}), "__named")
    within = Window.partitionBy("__named", "__bucket").orderBy("__place", "__tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__upto", F.sum("size").over(within)).join(totals, ["__named", "__bucket"])
    begin, whole, wanted = F.col("__earlier") + F.col("__upto") - F.col("size"), F.col("__source_size"), F.floor("__target")

    def one_pass(p: int) -> Column:
        start = begin + whole * p
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - start))
        position = demand_time(F.try_divide(start, F.col("__target")), F.col("__source_rank"), schedules)
        return F.when(words > 0, F.struct(F.lit(p).alias("pass"), words.alias("words"), position.alias("position")))

    passes = F.filter(F.array(*[one_pass(p) for p in range(most_repeats)]), lambda x: x.isNotNull())
    out = rows.withColumns({"source_size": F.col("__source_size"), "target": F.col("__target"), "passes": passes})
    out = out.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def training_order(mixed: DataFrame, wordless: bool = False) -> DataFrame:
    """One row per pass, range-sorted by training position, with ``pass``, ``words`` and ``position``.

    With ``wordless`` documents without words come once, at the beginning.
    """
    passes = F.col("passes")
    if wordless:
        once = F.struct(F.lit(0).alias("pass"), F.lit(0).cast("long").alias("words"), F.lit(0.0).alias("position"))
        passes = F.when(F.col("size") == 0, F.array(once)).otherwise(passes)
    rows = mixed.withColumn("__pass", F.explode(passes)).drop("passes")
    rows = rows.withColumns({c: F.col("__pass")[c] for c in ("pass", "words", "position")}).drop("__pass")
    return rows.orderBy("position", "doc_id", "pass")
