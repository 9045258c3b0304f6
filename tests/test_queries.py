"""Each query with SQL gives what DuckDB gives on the small tables."""

import math
import os

import duckdb
import pytest

from terrascape import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_matches_sql(spark, db, name):
    df = own.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({own.SQL[name]})").fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in want)


def test_each_other_query_is_held_against_a_plain_version():
    """Queries without SQL; each has a test of its name in test_plain.py."""
    from . import test_plain

    assert {f"test_{name}" for name in own.QUERIES.keys() - own.SQL.keys()} == {n for n in vars(test_plain) if n.startswith("test_")}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
