"""One query per operator, over the whole of its tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.llm import (
    curriculum_mix,
    decontaminate,
    histogram_shards,
    language_ppm,
    line_runs,
    maxent_lm,
    quality_outliers,
    secret_ownership,
    simhash_ball,
    substring_dedup,
    toxicity_nb,
    vector_codes,
    whitening,
)
from jobledger.llm.common import settle, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, width=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_outliers.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"
    )


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = ("doc_id", "source", curriculum_mix.word_count().alias("size"), curriculum_mix.text_hash().alias("tie"))
    docs = settle(table(spark, sf_dir, "documents").select(*slim), "sizes")
    mixed = curriculum_mix.mix(docs, F.col("size"), weights=(3, 1, 2), share=1.5, most_repeats=2, tie=F.col("tie"))
    first = F.try_element_at(F.transform("passes", lambda x: x["position"]), F.lit(1))
    shown = mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round(first, 9).alias("first_position"))
    return shown.orderBy("first_position", "doc_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.drop_shared_lines(docs, least_chars=40, least_docs=5).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        histogram_shards.text_then_id().alias("key"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    sharded = histogram_shards.shard_by_bytes(settle(rows, "sizes"), shards=16, tolerance=0.001)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secret_ownership.find_secrets(docs, most_owners=1)
    count = [secret_ownership.n_of_kind(F.col("base"), k).alias(f"n_{n}") for k, n in enumerate(("assign", "access", "hex"))]
    return found.select(
        "doc_id",
        *count,
        F.sha2(secret_ownership.listed(F.col("base")), 256).alias("base_sha256"),
        secret_ownership.listed(F.sort_array(F.concat("base", "live"))).alias("spans"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["to_word"] - s["from_word"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash_ball.near_duplicates(docs, shingle=4, distance=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_nb.train(docs, table(spark, sf_dir, "labels"), sample_rows=3000, folds=5, left_out=0)
    return toxicity_nb.score(docs, model).select(
        "doc_id",
        (toxicity_nb.remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = language_ppm.train(docs, sample_rows=1500, folds=4, left_out=2)
    return language_ppm.predict(docs.select("doc_id", "text"), trees).select(
        "doc_id", (toxicity_nb.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op11_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"), folds=7, left_out=2)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    digest = hashlib.sha256(",".join(map(str, found.codebooks.ravel().tolist())).encode()).hexdigest()
    return vector_codes.with_label_error(found.rows).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32, scale=64, offset=1_000_000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
