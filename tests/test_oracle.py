"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, digest
from panelmill.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    own = all_queries()
    assert set(own) == set(all_oracles()) <= set(QUERIES) and set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert digest(got) == digest(db.sql(SQL[name]).df())
