"""The driver contract: every query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from newsloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(cursor_rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    tell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(tell(r[k]) for k in order) for r in cursor_rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(cur.fetchall(), names)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
