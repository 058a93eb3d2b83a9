"""Each query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

from corpusloom import oracles, plan_oracles, plan_queries, queries

QUERIES = queries.QUERIES | plan_queries.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | plan_oracles.ORACLE_SQL

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return connection


def canonical(frame):
    rows = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted(map(repr, rows.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_queries_without_sql(spark):
    """What SQL can't express runs, and has rows."""
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, SF_DIR).count() > 0, name
