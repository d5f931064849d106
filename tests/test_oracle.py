"""Every query that has SQL gives the same rows as that SQL on another engine, on the smallest data set."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


@pytest.fixture(scope="module")
def other(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, data, other, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = other.execute(entry.oracle_sql()[name])
    at = [c[0] for c in result.description]
    assert sorted(at) == columns
    assert mine == sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
