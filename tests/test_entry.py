import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    optional = {n for n in entry.queries() if n == "pipeline" or n.startswith("op")}
    assert set(entry.queries()) - optional == set(entry.oracle_sql()) - optional
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["JobRoot", "JobID"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["per_job", "daily_metrics_all_days", "rule_statistics_sized", "box_points", "log_input_sizes", "streamed_dump"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import check

    db = duckdb.connect()
    for table in check.TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(SMALL, table)}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert check.table(df.columns, [tuple(r) for r in df.collect()]) == check.table(columns, result.fetchall())
    spark.catalog.clearCache()
