"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from obsengine.plans import queries as base

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(base.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = base.queries()[name](spark, SF)
    got = sorted(repr(tuple(r)) for r in df.collect())
    found = duck.execute(base.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
