"""Text quality by robust multivariate outliers: minimum covariance determinant (Rousseeuw).

Each text gives a vector of transformed statistics. For each language and source, the mean and covariance of the most
central texts are estimated: from three robust starts concentration steps repeat "order by Mahalanobis distance, keep the
nearest half, estimate again" until the determinant falls no more; the start that ends with the smallest one counts.
Equal vectors of a group count once in its estimates, so copies, however many, cannot become its centre. Distances are
scaled so that their median is that of a chi-square variable. After one reweighting step, texts beyond the cutoff are
rejected.

Only built-in functions. Scale: a step is one aggregation. Distances are counted in fine logarithmic bins together with
the sums that mean and covariance need, so the nearest share and its estimates come out of the same pass, with map-side
combining; a group of a third of all rows is a few hundred rows after it. Small groups look up the estimate of all texts of
their language, or of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.llm.common import WORD, settle

FEATURES = ("f_size", "f_length", "f_symbols", "f_lines", "f_repeats")
D = len(FEATURES)
# Places of a lower triangle's elements in an array.
PLACE = {(i, j): i * (i + 1) // 2 + j for i in range(D) for j in range(i + 1)}
# Smallest standard deviation of each feature: statistics that nearly all texts of a group share exactly.
FLOORS = (0.5, 0.3, 0.3, 0.25, 0.25)
SHARE = 0.5
# Logarithm of the determinant: a step that lowers it by less is the last.
LEAST_FALL = 1e-3
LEAST_ROWS = 100
# Quantiles of chi-square with five degrees of freedom at 0.5 and 0.975.
CHI_MEDIAN, CHI_INNER = 4.351, 12.833
CUTOFF = 40.0
BINS_PER_DOUBLING = 16


def statistics(text: Column) -> dict[str, Column]:
    """Counts of one text, each expression bound once; null is empty."""
    content = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(content, F.lit(WORD), F.lit(0))
    counted = F.get(F.transform(F.array(words), _of_words), F.lit(0))
    lines = F.filter(F.split(content, "\n", -1), lambda line: line.rlike(WORD))
    of_lines = F.get(F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))), F.lit(0))
    return {"__words": counted, "__lines": of_lines, "n_symbols": F.regexp_count(content, F.lit("[#*$%&|<>]")).cast("long")}


def _of_words(words: Column) -> Column:
    chars = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    repeats = F.when(F.size(words) > 3, F.get(F.transform(F.array(_windows(words)), _repeated), F.lit(0))).otherwise(F.lit(0).cast("long"))
    return F.struct(F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), repeats.alias("n_repeat_words"))


def _windows(words: Column) -> Column:
    """Three-word windows with their places, sorted. Words hold no space, so joining keeps windows apart."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))


def _repeated(windows: Column) -> Column:
    """Number of words in windows that occur twice or more."""
    same = lambda a, b: F.coalesce(F.get(windows, a)["w"] == F.get(windows, b)["w"], F.lit(False))
    places = F.filter(F.transform(windows, lambda x, k: F.when(same(k, k + 1) | (F.when(k > 0, same(k, k - 1)).otherwise(F.lit(False))), x["i"])), lambda i: i.isNotNull())
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"))
    return F.aggregate(F.sort_array(places), start, step, lambda s: s["n"])


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``."""
    found = docs.select(*[c for c in docs.columns if c != text], *[c.alias(n) for n, c in statistics(F.col(text)).items()])
    names = [c for c in docs.columns if c != text]
    return found.select(
        *names, "__words.n_words", "__words.word_chars", "n_symbols", F.col("__lines.n_lines").cast("long").alias("n_lines"),
        F.col("__lines.n_dup_lines").cast("long").alias("n_dup_lines"), "__words.n_repeat_words",
    )


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "f_size": F.log1p("n_words"),
        "f_length": F.col("word_chars") / words,
        "f_symbols": F.log(F.lit(0.01) + F.col("n_symbols") / chars),
        "f_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "f_repeats": F.sqrt(F.col("n_repeat_words") / words),
    }


def _grown(start: Column, extend: Callable[[Column], Column]) -> Column:
    """The array with one more element, bound so that later elements can use it without computing it again."""
    return F.get(F.transform(F.array(start), lambda done: F.concat(done, F.array(extend(done)))), F.lit(0))


def cholesky(cov: dict[tuple[int, int], Column]) -> Column:
    """Lower triangle of the factor, row after row, as an array."""

    def element(i: int, j: int) -> Callable[[Column], Column]:
        def extend(done: Column) -> Column:
            left = cov[(i, j)]
            for k in range(j):
                left = left - F.get(done, F.lit(PLACE[(i, k)])) * F.get(done, F.lit(PLACE[(j, k)]))
            return F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.get(done, F.lit(PLACE[(j, j)]))

        return extend

    state = F.array().cast("array<double>")
    for i, j in PLACE:
        state = _grown(state, element(i, j))
    return state


def squared_distance(factor: Column, centred: list[Column]) -> Column:
    """Mahalanobis distance from the factor: squared length of the forward solution."""

    def element(i: int) -> Callable[[Column], Column]:
        def extend(done: Column) -> Column:
            left = centred[i]
            for k in range(i):
                left = left - F.get(factor, F.lit(PLACE[(i, k)])) * F.get(done, F.lit(k))
            return left / F.get(factor, F.lit(PLACE[(i, i)]))

        return extend

    state = F.array().cast("array<double>")
    for i in range(D):
        state = _grown(state, element(i))
    return F.aggregate(state, F.lit(0.0), lambda a, x: a + x * x)


def estimates(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums that mean and covariance need."""
    sums = [F.count("*").alias("n")] + [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}{j}") for i in range(D) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*sums)


SUMS = ["n", *[f"s{i}" for i in range(D)], *[f"s{i}{j}" for i in range(D) for j in range(i + 1)]]


def log_determinant(factor: Column) -> Column:
    return sum((2 * F.log(F.get(factor, F.lit(PLACE[(i, i)]))) for i in range(D)), F.lit(0.0))


def shapes(sums: DataFrame, *keys: str) -> DataFrame:
    """``keys``, mean and Cholesky factor of the covariance, whose variances are raised by the floors."""
    mean = {i: F.col(f"s{i}") / F.col("n") for i in range(D)}
    cov = {(i, j): F.col(f"s{i}{j}") / F.col("n") - mean[i] * mean[j] + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(D) for j in range(i + 1)}
    return sums.select(*keys, F.array(*mean.values()).alias("mean"), cholesky(cov).alias("factor"))


def with_distance(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """Rows with ``d2`` and its bin; no hint: the table of groups is sent to all executors only if it is small."""
    centred = [F.col(f) - F.get("mean", F.lit(i)) for i, f in enumerate(FEATURES)]
    d2 = squared_distance(F.col("factor"), centred)
    near = rows.join(shape, "group").withColumn("d2", d2).drop("mean", "factor")
    return near.withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-9) * BINS_PER_DOUBLING).cast("int"))


def nearest(binned: DataFrame, share: float, *keys: str) -> DataFrame:
    """Sums of the nearest ``share`` of each group (the last bin in part), and the distance in the middle (``median``)."""
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    placed = binned.withColumns({"__before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "__all": F.sum("n").over(whole)})
    middle = F.min(F.when(F.col("__before") + F.col("n") >= F.col("__all") / 2, F.col("bin")))
    wanted = F.least(F.col("__all").cast("double"), F.col("__all") * share + (D + 1) / 2)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wanted - F.col("__before")) / F.col("n")))
    sums = [F.sum(part * F.col(s)).alias(s) for s in SUMS]
    return placed.groupBy(*keys).agg(*sums, F.pow(F.lit(2.0), (middle + 0.5) / BINS_PER_DOUBLING).alias("median"))


def starting_shapes(rows: DataFrame) -> DataFrame:
    """Three centres and widths for each group and feature, from counts of values in bins of a hundredth.

    0: median and quartile range; 1: median and twice the smaller half of that range; 2: the middle and the width of the
    shortest of eleven ranges with half of the values.
    """
    cells = rows.select("group", F.posexplode(F.array(*[F.floor(F.col(f) * 100) for f in FEATURES])).alias("f", "bin"))
    counts = cells.groupBy("group", "f", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("group", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({"__upto": F.sum("n").over(upto), "__all": F.sum("n").over(Window.partitionBy("group", "f"))})
    at = lambda q: F.min(F.when(F.col("__upto") >= F.col("__all") * q, F.col("bin"))) / 100
    found = placed.groupBy("group", "f").agg(*[at(k / 20).alias(f"q{k}") for k in range(21)])
    halves = F.array_min(F.array(*[F.struct((F.col(f"q{k + 10}") - F.col(f"q{k}")).alias("width"), ((F.col(f"q{k + 10}") + F.col(f"q{k}")) / 2).alias("middle")) for k in range(11)]))
    around = F.least(F.col("q15") - F.col("q10"), F.col("q10") - F.col("q5")) * 2
    starts = [(F.col("q10"), F.col("q15") - F.col("q5")), (F.col("q10"), around), (halves["middle"], halves["width"])]
    start = F.array(*[F.struct(m.alias("middle"), (w / 1.349).alias("deviation")) for m, w in starts])
    each = found.select("group", "f", F.posexplode(start).alias("start", "s"))
    wide = each.groupBy("group", "start").agg(
        *[F.max(F.when(F.col("f") == i, F.col("s.middle"))).alias(f"m{i}") for i in range(D)],
        *[F.max(F.when(F.col("f") == i, F.col("s.deviation"))).alias(f"d{i}") for i in range(D)],
    )
    cov = {(i, j): F.col(f"d{i}") ** 2 + FLOORS[i] ** 2 if i == j else F.lit(0.0) for i in range(D) for j in range(i + 1)}
    return wide.select("group", "start", F.array(*[F.col(f"m{i}") for i in range(D)]).alias("mean"), cholesky(cov).alias("factor"))


def concentrated(rows: DataFrame) -> DataFrame:
    """``group, mean, factor`` of the smallest determinant that any start ends with."""
    keys = ("group", "start")
    active = settle(starting_shapes(rows).withColumn("before", F.lit(None).cast("double")), "shapes")
    ended = None
    while not active.isEmpty():
        step = nearest(estimates(with_distance(rows, active), *keys, "bin"), SHARE, *keys)
        step = shapes(step, *keys).withColumn("log_det", log_determinant(F.col("factor")))
        step = settle(step.join(active.select(*keys, "before"), [*keys]), "shapes")
        # A determinant that a start itself had is none of a nearest half, so the first step always goes on.
        falls = F.coalesce(F.col("log_det") < F.col("before") - LEAST_FALL, F.lit(True))
        done = step.where(~falls).select("group", F.struct("log_det", "start", "mean", "factor").alias("shape"))
        ended = done if ended is None else ended.union(done)
        active = step.where(falls).select(*keys, "mean", "factor", F.col("log_det").alias("before"))
    if ended is None:
        return active.select("group", "mean", "factor")
    return ended.groupBy("group").agg(F.min("shape").alias("shape")).select("group", "shape.mean", "shape.factor")


def grouped(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """``group``: language and source; the language alone, or nothing, for groups of fewer than ``least`` different vectors.

    ``groups``: all groups whose estimates the row takes part in.
    """
    lang, both = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}), F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    rows = rows.withColumns({"__lang": lang, "__both": both})
    counts = rows.select("__lang", "__both", *FEATURES).distinct().groupBy("__lang", "__both").agg(F.count("*").alias("__n"))
    of_lang = Window.partitionBy("__lang")
    counts = counts.withColumns({"__of_lang": F.sum("__n").over(of_lang), "__small": F.min("__n").over(of_lang) < least})
    group = F.when(F.col("__n") >= least, F.col("__both")).when(F.col("__of_lang") >= least, F.col("__lang")).otherwise(F.lit("all"))
    own = F.when(F.col("__n") >= least, F.col("__both"))
    language = F.when(F.col("__small") & (F.col("__of_lang") >= least), F.col("__lang"))
    groups = F.array_compact(F.array(own, language, F.lit("all")))
    return rows.join(counts.select("__both", group.alias("group"), groups.alias("groups")), "__both").drop("__lang", "__both")


def judge(docs: DataFrame, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the statistics, ``base_failed``, ``d2`` (scaled) and ``kept`` of each row.

    Base: fewer than 50 words, or more than half of the words in repeated windows; such rows are not kept and take no
    part in the estimates. Null and empty texts have 0 words. Null languages and sources are groups of their own.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = text_statistics(docs.select("doc_id", "lang", "source", text), text).withColumn("base_failed", failed)
    rows = settle(rows.withColumns(features()), "text-statistics")
    labelled = settle(grouped(rows.where("NOT base_failed")), "labelled-texts")
    sound = labelled.select(F.explode("groups").alias("group"), *FEATURES)
    used = labelled.select("group").distinct()
    sound = settle(sound.join(used, "group", "left_semi").distinct(), "sound-texts")
    shape = settle(concentrated(sound), "shapes")
    # Reweighting: everything inside the inner quantile, on the scale of the median.
    binned = settle(estimates(with_distance(sound, shape), "group", "bin"), "distances")
    scale = nearest(binned, SHARE, "group").select("group", (F.col("median") / CHI_MEDIAN).alias("__scale"))
    inside = binned.join(scale, "group").where(F.pow(F.lit(2.0), F.col("bin") / BINS_PER_DOUBLING) <= CHI_INNER * F.col("__scale"))
    shape = settle(shapes(inside.groupBy("group").agg(*[F.sum(s).alias(s) for s in SUMS]), "group"), "shapes")
    median = nearest(estimates(with_distance(sound, shape), "group", "bin"), SHARE, "group").select("group", (F.col("median") / CHI_MEDIAN).alias("__scale"))
    final = settle(shape.join(median, "group"), "shapes")
    judged = with_distance(labelled, final).withColumn("d2", F.col("d2") / F.greatest(F.col("__scale"), F.lit(1.0)))
    columns = [c for c in rows.columns if c not in FEATURES]
    out = judged.select(*columns, "d2", (F.col("d2") <= cutoff).alias("kept"))
    rest = rows.where("base_failed").select(*columns, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return out.unionByName(rest)
