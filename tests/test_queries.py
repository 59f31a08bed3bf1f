"""Every registered query against its DuckDB twin on the smallest fixture."""

import pytest

import __spark_entry__ as entry
from basketry.plans.queries import QUERIES
from tests.oracle_harness import compare, duck
from tests.conftest import SF_SMALL

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(name, spark, con, SF_SMALL, QUERIES[name], ORACLE.get(name))
    assert res["status"] in ("OK", "rows-only"), res


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "behavior_segment" in df.columns


def test_every_query_has_an_oracle():
    assert sorted(set(QUERIES) - set(ORACLE)) == []
