"""The registered queries and the driver functions."""

import duckdb

import __spark_entry__ as entry

from tests.conftest import DATA
from tickloom.plans import catalog


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == catalog.QUERIES["surge_ranked"](spark, DATA).columns
    assert out.count() > 0


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert set(catalog.SQL) == set(catalog.QUERIES) <= set(q)


def test_no_query_proves_nothing():
    """Every SQL text has rows on the given tables; the queries equal them (check.py)."""
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA.replace('0.001', '0.01')}/{t}.parquet'")
    empty = [name for name, sql in entry.oracle_sql().items() if not con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]]
    assert empty == []
