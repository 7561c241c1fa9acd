"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import pytest

from lexweave.queries import load

QUERIES = load()


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_matches_sql(spark, data, same, name):
    run, sql = QUERIES[name]
    same(run(spark, data), sql)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_runs(spark, data, name):
    df = QUERIES[name][0](spark, data)
    assert len(df.columns) > 0
    df.collect()
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
