"""Every registered core query against its SQL, on the smallest tables."""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tracequarry.plans.queries import SQL, Q  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = Q[name](spark, DATA)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = Counter(tuple(r[columns.index(c)] for c in order) for r in found.fetchall())
    assert Counter(tuple(r[c] for c in order) for r in got.collect()) == want


def test_all_queries_have_sql():
    assert set(Q) == set(SQL)
