"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from plumbline.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.REGISTRY.items() if sql])
def test_query_equals_its_sql(spark, duck, name):
    query, sql = catalog.REGISTRY[name]
    made = query(spark, DATA)
    want = duck.execute(sql)
    assert rows(made.columns, [tuple(r) for r in made.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
