"""Every registered query that has SQL gives what DuckDB finds on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from evidrill import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(v) if isinstance(v, float) else str(v)[:19] if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cur = duck.execute(plans.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in cur.fetchall())
    assert got == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
