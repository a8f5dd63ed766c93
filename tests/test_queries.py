"""Every registered query against its SQL, on the smallest data set."""

from __future__ import annotations

import pytest

from basketlens.plans.registry import all_queries, all_sql

from .compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# Selective on so little data.
MAY_BE_EMPTY = {"catalog_filter", "sales_by_category"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    assert got or name in MAY_BE_EMPTY
    sql = all_sql().get(name)
    if sql is not None:
        rel = duck.execute(sql)
        want = [d[0] for d in rel.description], rel.fetchall()
        assert compare((df.columns, got), want) is None


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
