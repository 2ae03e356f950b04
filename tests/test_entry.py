"""Entry contract: every query runs and, where stated, equals its SQL on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    line, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, line
