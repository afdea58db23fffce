"""Every query with SQL gives the same rows on DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tokenloom.queries_corpus import oracle_sql

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(rows):
    def cell(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert plain(got) == plain([tuple(r[i] for i in at) for r in want.fetchall()])
