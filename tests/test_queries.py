"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from memloom.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    made, told = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).fetch_df()
    assert sorted(made.columns) == sorted(told.columns)
    assert rows(made) == rows(told)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
