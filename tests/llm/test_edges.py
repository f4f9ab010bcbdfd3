"""Empty tables, nulls everywhere, and columns that have the names of results."""

import os

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from jobledger.llm import (
    curriculum_mix,
    decontaminate,
    histogram_shards,
    language_ppm,
    line_runs,
    quality_outliers,
    queries,
    secret_ownership,
    simhash_ball,
    sql,
    substring_dedup,
    toxicity_nb,
)

SMALL = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def shards(docs):
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    return histogram_shards.shard_by_bytes(docs.withColumns({"key": histogram_shards.text_then_id(), "size": size}))


def toxic(docs):
    return toxicity_nb.score(docs, toxicity_nb.train(docs, docs.sparkSession.createDataFrame([(0, 1, 1), (3, 1, 0), (None, None, None)], LABELS)))


def passages(docs):
    return decontaminate.find_passages(docs, docs.sparkSession.createDataFrame([(1, "a b c d e f g h i j k"), (None, None)], "item_id long, text string"))


OPERATORS = {
    "op1": substring_dedup.remove_repeats,
    "op2": quality_outliers.judge,
    "op3": lambda docs: curriculum_mix.mix(docs, curriculum_mix.word_count()),
    "op4": line_runs.drop_shared_lines,
    "op5": shards,
    "op6": secret_ownership.find_secrets,
    "op7": passages,
    "op8": simhash_ball.near_duplicates,
    "op9": toxic,
    "op10": lambda docs: language_ppm.predict(docs, language_ppm.train(docs)),
}
CLASHES = ["key", "tag", "n_words", "n_removed", "kept_text", "score", "shard", "slot", "fingerprint", "component", "target", "passes", "spans", "group", "bin", "value", "n_lines", "batch", "h1", "lang_pred", "hit_spans", "base", "d2", "__key"]


@pytest.fixture(scope="module")
def cases(spark):
    some = spark.createDataFrame(brute.corpus(4, n=20), brute.COLUMNS)
    return {
        "empty": (some.limit(0), 0),
        "nulls": (some.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in some.dtypes]), 3),
        "clashes": (some.withColumns({c: F.lit(None).cast("date") if i % 2 else F.lit("x") for i, c in enumerate(CLASHES) if c != "key"}), 25),
        "repeated": (some.union(some), 50),
    }


@pytest.mark.parametrize("case", ["empty", "nulls", "clashes", "repeated"])
@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(cases, name, case):
    docs, n = cases[case]
    found = OPERATORS[name](docs)
    rows = found.collect()
    assert len(rows) == n
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(r["doc_id"]) for r in docs.select("doc_id").collect())
    if case == "repeated" and name not in ("op3", "op5"):
        # Rows that repeat as a whole have equal results, apart from their own place in a mix or shard.
        # (Of those two the contents of the mix and the sizes of the shards are tested with repeated rows.)
        shown = [repr(r) for r in rows]
        assert all(shown.count(r) % 2 == 0 for r in set(shown))


def test_a_source_without_words(spark):
    docs = spark.createDataFrame([(1, "", "en", "a"), (2, None, "en", "a"), (3, "x y z", "en", "b")], brute.COLUMNS)
    taken = {r["doc_id"]: (r["target"], r["taken"]) for r in curriculum_mix.mix(docs, curriculum_mix.word_count()).collect()}
    assert taken == {1: (0.0, 0), 2: (0.0, 0), 3: (4.5, 4)}


def write(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i * 3, 1, int(i % 5 == 0)) for i in range(40)], LABELS).write.parquet(f"{folder}/labels.parquet")
    items = [(7, " ".join(brute.words(brute.corpus(6)[8][1])[2:16])), (8, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


@pytest.mark.parametrize("case", ["empty", "nulls", "clashes", "repeated"])
def test_stages_keep_the_columns(spark, cases, tmp_path, case):
    docs, _ = cases[case]
    write(spark, str(tmp_path), docs)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.settle(stage(spark, docs, str(tmp_path)), name)
        added = ["shard", "slot"] if name == "sharding" else []
        assert docs.columns == [c for c in before.columns if c not in added] + added
    # Of rows without words one stays, as they are copies of each other.
    assert docs.count() == {"empty": 0, "nulls": 1}.get(case, docs.count())
    assert case not in ("clashes", "repeated") or docs.where("text IS NOT NULL").count() > 0


def test_pipeline_against_plain_stages(spark, tmp_path):
    data = brute.corpus(6)
    items = write(spark, str(tmp_path), spark.createDataFrame(data, brute.COLUMNS))
    docs, stages = spark.createDataFrame(data, brute.COLUMNS), dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(df.collect(), key=repr)
    clean = corpus_pipeline.settle(stages["toxicity"](spark, docs, str(tmp_path)), "a")
    model = toxicity_nb.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert rows(clean) == rows(toxicity_nb.score(docs, model).where("score < 0.5").drop("score"))
    single = corpus_pipeline.settle(stages["near_duplicates"](spark, clean, str(tmp_path)), "b")
    prints = [(r["doc_id"], brute.simhash(r["text"])) for r in clean.collect()]
    assert {r["doc_id"] for r in single.collect()} == set(brute.linked(prints))
    pure = corpus_pipeline.settle(stages["decontamination"](spark, single, str(tmp_path)), "c")
    hits = brute.benchmark_hits([tuple(r) for r in single.collect()], items)
    assert {r["doc_id"] for r in pure.collect()} == {d for d, _, n, _ in hits if not n} and any(n for _, _, n, _ in hits)
    mixed = corpus_pipeline.settle(stages["mixing"](spark, pure, str(tmp_path)), "d")
    sizes = {}
    for r in pure.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    largest = max(len(brute.words(r["text"])) for r in pure.collect())
    for source, target in brute.targets(sizes).items():
        taken = sum(len(brute.words(r["text"])) for r in mixed.collect() if r["source"] == source)
        assert abs(taken - target) <= largest
    final = stages["sharding"](spark, mixed, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)[:-2]) for r in final) == sorted(repr(tuple(r)) for r in mixed.collect())
    assert sorted((r["shard"], r["slot"]) for r in final) == [(s, i) for s in range(16) for i in range(sum(r["shard"] == s for r in final))]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(sql.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import check

    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    result = db.execute(sql.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert check.table(df.columns, [tuple(r) for r in df.collect()]) == check.table(columns, result.fetchall())
