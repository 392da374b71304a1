"""Every registered SQL-expressible query equals its DuckDB oracle (sf0.001)."""

import pytest

from conftest import SF_SMALL
from oracle_check import compare, duck
from pulsepanel.plans.catalog import oracle_sql, queries

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    problems, _ = compare(spark, name, queries()[name], oracle_sql()[name], SF_SMALL, con)
    assert not problems, problems
