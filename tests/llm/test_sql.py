"""Queries of the training-data problems against their SQL, and all of them running."""

import os

import duckdb
import pytest

from tokenloom.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = q.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({q.oracle_sql()[name]})").fetchall()
    key = lambda r: repr([round(float(x), 6) if isinstance(x, (int, float)) else x for x in r])
    assert sorted(key([r[c] for c in columns]) for r in df.collect()) == sorted(map(key, want))


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs_on_whole_tables(spark, sf, name):
    assert q.queries()[name](spark, sf).count() > 0


FOUND = {"p1_found": ["id"], "p2_found": ["id"], "p3_found": ["token_a", "token_b"], "p4_found": ["doc_id", "topic"], "p5_found": ["kind", "term", "mark"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


def test_columns_as_stated(spark, sf):
    for name, columns in FOUND.items():
        assert q.queries()[name](spark, sf).columns == columns
