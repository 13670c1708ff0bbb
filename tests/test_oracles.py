"""Every query with SQL gives the rows of that SQL at the smallest scale."""

import os

import duckdb
import pytest

from oxbow.plans import catalog

catalog.load()


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(want.columns, want.fetchall())
