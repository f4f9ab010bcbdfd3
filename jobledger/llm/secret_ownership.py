"""Secrets in texts, told from examples by corpus-wide ownership.

Patterns find candidates in each text; every candidate is then counted over the whole corpus by a 128-bit hash of its value:
with how many owners (sources) it occurs, and in how many repositories. The tables name no repositories, so different texts of
one owner stand for them. A value that several owners have is an example that is copied widely. A value that one owner has,
in however many repositories and documents, and that looks random, is reported as live; its number of repositories is
reported with it.

Only built-in functions. Positions come from the texts between matches: lengths of ``split`` and of the matches add up
to code points. They are summed in runs of ``RUN`` matches and the runs' totals once more, so that very long texts with very
many matches take time in proportion. Values themselves are neither stored nor shuffled. Counting is in steps, each with
map-side combining, so a value found in a third of all documents is reduced to its owners before it meets in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobledger.llm.common import doc_key, settle, text_tag

# The patterns of the base rules, in order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# End of the fixed values. A run of key characters is maximal, so asking for the least length in the pattern finds the same.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
FREE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "live")
SPAN = "struct<start:int,kind:int,end:int,at:int,digest:binary,random:boolean>"
# Matches whose positions are summed at a time.
RUN = 64


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, as the element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def positions(lengths: Column) -> Column:
    """Running sums of an array of integers, each without its own element."""

    def sums(values: Column, start: Column) -> Column:
        state = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("before"))
        step = lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before"))
        return F.aggregate(values, state, step, lambda s: s["before"])

    part = lambda values, run: F.slice(values, run * RUN + 1, F.lit(RUN))

    def of_runs(values: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))
        totals = F.transform(runs, lambda r: F.aggregate(part(values, r), F.lit(0), lambda a, n: a + n))
        starts = sums(totals, F.lit(0))
        return _bound(starts, lambda begin: F.flatten(F.transform(runs, lambda r: sums(part(values, r), F.get(begin, r)))))

    none = F.array().cast("array<int>")
    return _bound(lengths, lambda values: F.when(F.size(values) > 0, of_runs(values)).otherwise(none))


def spans(text: Column, pattern: str, kind: int, possible: Column, least: int = 0, value_group: int = 0, mixed: bool = False) -> Column:
    """Leftmost non-overlapping matches: start, kind, end, start of the value, its hash and whether it looks random.

    ``least`` is the length a value needs. Matches that fail it are dropped after matching, so they still take their place.
    ``mixed`` values have letters of both cases and digits.
    """
    none = F.array().cast(f"array<{SPAN}>")
    whole = f"^{pattern}$" if not pattern.startswith("(?i)") else f"(?i)^{pattern[4:]}$"

    def span(match: Column, begin: Column) -> Column:
        end = begin + F.length(match)
        value = F.regexp_extract(match, whole, value_group) if value_group else match

        def known(v: Column) -> Column:
            fits = F.length(v) >= least
            if mixed:
                fits = fits & v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
            cells = {"start": begin, "kind": F.lit(kind), "end": end, "at": end - F.length(v), "digest": F.unhex(F.md5(v.cast("binary"))), "random": looks_random(v)}
            return F.when(fits, F.struct(*[c.alias(n) for n, c in cells.items()]))

        return _bound(value, known)

    def located(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def placed(gaps: Column) -> Column:
            # The text before a match, after the match before it.
            ends = positions(F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))
            return _bound(ends, lambda before: F.transform(matches, lambda m, i: span(m, F.get(before, i) + F.length(F.get(gaps, i)))))

        return F.when(F.size(matches) > 0, _bound(gaps, placed))

    found = _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    found = F.filter(found, lambda s: s.isNotNull()).cast(f"array<{SPAN}>")
    return F.when(possible, F.coalesce(found, none)).otherwise(none)


def looks_random(value: Column) -> Column:
    """At least 10 different characters, and digits as well as letters."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return (kinds >= 10) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def candidates(docs: DataFrame, doc_id: str, owner: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    lowered = F.lower(content)
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | F.contains(lowered, F.lit(word))
    always = F.lit(True)
    base = F.concat(
        spans(content, ASSIGN, 0, named, least=12, value_group=2),
        spans(content, ACCESS_LONG, 1, F.contains(content, F.lit("AKIA"))),
        spans(content, HEX_LONG, 2, always),
    )
    free = spans(content, FREE, 3, always, mixed=True)
    owned = F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), doc_key(doc_id).alias("key"), text_tag(text).alias("tag"), owned.alias("owner"), base.alias("base"), free.alias("free"))
    return settle(rows, "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """``digest, owner, tag`` -> ``digest``, distinct ``owners`` and distinct ``repositories`` (texts of an owner)."""
    of_owner = found.select("digest", "owner", "tag").distinct().groupBy("digest", "owner").agg(F.count("*").alias("texts"))
    return of_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("texts").alias("repositories"))


def find_secrets(docs: DataFrame, most_owners: int = 1, doc_id: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` and ``live`` spans, each sorted, and ``repositories``.

    ``base`` are the fixed rules' spans. ``live`` are spans of values (of base spans, and of free runs of key characters)
    that at most ``most_owners`` owners have, in any number of documents, and that look random; ``repositories`` are in how
    many repositories the most widespread of them is (null without any). Null and empty texts have no spans; a null owner is
    one owner; rows that repeat have equal results and count once. Texts of any length are searched whole.
    """
    rows = candidates(docs, doc_id, owner, text)
    every = rows.select("key", "tag", "owner", F.explode(F.concat("base", "free")).alias("span")).where("span.random")
    every = every.select("key", "tag", "owner", "span.at", "span.end", "span.digest")
    few = ownership(every).where(F.col("owners") <= most_owners)
    place = F.struct(F.col("at").alias("start"), F.lit(3).alias("kind"), "end")
    live = every.join(few, "digest").groupBy("key", "tag").agg(F.collect_set(place).alias("live"), F.max("repositories").alias("repositories"))
    short = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    found = rows.join(live, ["key", "tag"], "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.select("doc_id", F.sort_array(short).alias("base"), F.sort_array(F.coalesce("live", empty)).alias("live"), "repositories")


def n_of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
