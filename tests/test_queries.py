"""Every registered query against its SQL, or at least against its rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SMALL}/{t}.parquet'")
    return con


def test_every_sql_belongs_to_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def same(a, b) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) and ((a == b) | (a.isna() & b.isna())).all(axis=None)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, db, name):
    same(entry.queries()[name](spark, SMALL).toPandas(), db.sql(entry.oracle_sql()[name]).df())


#: Queries that SQL can't express; what they give is tested apart, and here that they run over their whole tables.
REST = {"c7_trained": 2, "stream_conversations": 1}


@pytest.mark.parametrize("name", sorted(REST))
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, SMALL).count() >= REST[name]


def test_every_query_is_tested():
    core = {n for n in entry.queries() if n != "pipeline" and not n.startswith("op")}
    assert core == {n for n in entry.oracle_sql() if not n.startswith("op")} | REST.keys()


def test_smoke(spark):
    assert entry.entry(spark).count() > 0
