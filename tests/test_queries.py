"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle_check import compare, connect

from embertrace.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    problem = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
    assert problem is None, problem


def test_every_query_has_sql_or_runs(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, sf_dir).count() > 0
