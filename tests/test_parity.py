"""Each catalog query against its SQL in another engine, on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import captures, catalog, gates, vectors

QUERIES, SQL = catalog.QUERIES | vectors.QUERIES | captures.QUERIES | gates.QUERIES, catalog.SQL | vectors.SQL | captures.SQL | gates.SQL
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_entry_has_a_row_and_every_query_is_callable(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
