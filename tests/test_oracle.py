"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import differences, duckdb_views

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF)


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_duckdb(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, ORACLE[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["res_pays", "value"]
