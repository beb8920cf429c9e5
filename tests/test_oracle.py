"""Every query with an oracle matches DuckDB exactly at sf0.01 (whole
tables); queries without one run and return rows."""

import pytest

from __spark_entry__ import oracle_sql, queries
from oracle_harness import compare, duck

from paths import SF01

EXACT = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", EXACT)
def test_exact_query_matches_duckdb(spark, con, name):
    res = compare(spark, name, SF01, con)
    assert res["status"] == "match", res


def test_every_query_is_registered_with_a_callable():
    q = queries()
    assert set(oracle_sql()) <= set(q)
    assert len(q) >= 60
