"""Every query with a DuckDB twin gives its rows."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from maskwright.plans import request_queries, store_queries  # noqa: E402, F401
from maskwright.plans.queries import ORACLES, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    return tuple(map(value, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(value(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)


@pytest.mark.parametrize("name", ["wallet_search_sort", "consent_page", "log_page"])
def test_order_as_it_comes(spark, duck, data, name):
    """Lists whose order is part of the answer are compared unsorted."""
    df = QUERIES[name](spark, data)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(value(r[names.index(c)]) for c in df.columns) for r in cursor.fetchall()]
    assert [tuple(value(v) for v in r) for r in df.collect()] == want and len(want) > 1


@pytest.mark.parametrize("name", ["activity_feed", "system_scope"])
def test_feeds_are_newest_first(spark, data, name):
    ids = [r["id"] for r in QUERIES[name](spark, data).collect()]
    assert ids == sorted(ids, reverse=True) and len(ids) > 1
