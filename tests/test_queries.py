"""Every registered query outside llm that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from annalist.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(found):
    return sorted(map(repr, found))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalog.SQL:
        assert got
        return
    cur = db.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows(got) == rows(tuple(r[k] for k in order) for r in cur.fetchall())
