"""Every registered query against DuckDB on the smallest shared tables."""

import pytest

from eventloom.registry import load_all
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load_all()))
def test_matches_oracle(spark, duck, name):
    problem, _, _, _ = compare(spark, duck, name, load_all()[name], FOLDER)
    assert problem is None, problem


def test_every_query_has_an_oracle():
    assert [name for name, entry in load_all().items() if not entry.sql] == []


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["bucket", "severity", "count"]
    assert load_all().keys() <= entry.oracle_sql().keys() <= entry.queries().keys()
