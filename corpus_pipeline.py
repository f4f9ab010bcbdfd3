"""From raw documents to shards: the stages a training corpus goes through.

Each stage takes all rows that the one before kept. All but the last return the columns of ``documents``; columns of the
input that have the name of a stage's own column are kept as they are. Rows with null, empty or blank texts pass the filters
(of them the near-duplicate stage keeps one, as they are copies of each other). Very long texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.llm import curriculum_mix, decontaminate, histogram_shards, simhash_ball, toxicity_nb
from jobledger.llm.common import settle, table

OWN = ("doc_id", "text", "source")


def _aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame], *also: str) -> DataFrame:
    """Does ``work`` with all columns it does not read under names of their own, and names them back."""
    names = {c: c if c in OWN else f"column_{i}" for i, c in enumerate(docs.columns)}
    done = work(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return done.select(*[F.col(n).alias(c) for c, n in names.items() if c not in also], *also)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least 0.5 go."""
    model = toxicity_nb.train(docs, table(spark, sf_dir, "labels"), sample_rows=3000)
    return _aside(docs, lambda rows: toxicity_nb.score(rows, model).where("score < 0.5"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of four-word shingles that differ in 4 bits or fewer, the smallest id stays."""
    return _aside(docs, lambda rows: simhash_ball.keep_one(rows, shingle=4, distance=4))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any ten consecutive words of a benchmark item go."""
    items = table(spark, sf_dir, "benchmark")
    return _aside(docs, lambda rows: decontaminate.find_passages(rows, items, window=10).where("size(hit_spans) = 0"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per pass in which at least half of its words are taken, in training order.

    So documents of small sources appear twice, and documents at the end of a large source's order do not appear. The
    half rule takes the document at the end of a target if that brings its source nearer to the target. Documents without
    words count towards no target; they come once, first.
    """

    def work(rows: DataFrame) -> DataFrame:
        mixed = curriculum_mix.mix(rows, curriculum_mix.word_count(), weights=(3, 1, 2), share=1.5, most_repeats=2)
        return curriculum_mix.training_order(mixed, wordless=True).where("2 * words >= size")

    return _aside(docs, work)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard (0 to 15, equal bytes) and their place in it."""

    def work(rows: DataFrame) -> DataFrame:
        size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")
        # The rows are read from the files of the stage before, so a row has the same number whenever it is read.
        return histogram_shards.shard_by_bytes(rows.withColumns({"key": histogram_shards.text_then_id(), "size": size}), shards=16)

    return _aside(docs, work, "shard", "slot")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
# The classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
