"""Every registered query against its SQL form on the smallest tables."""

import pytest

import __spark_entry__ as entry
from verify import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_form_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    result, _ = compare(spark, con, name, SF)
    assert result.startswith(("ok", "rows only")), result


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
