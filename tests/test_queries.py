"""Every query of the library against its SQL, and the entry points."""

import duckdb
import pandas as pd
import pytest

from spanveil import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    plain = lambda v: "null" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_sql_belongs_to_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and queries.FLAGSHIP in queries.QUERIES
