"""Every catalogue query against its DuckDB twin at sf0.01 (the driver's correctness gate)."""

import pytest

import __spark_entry__ as E
from reelflow.plans.catalog import QUERIES
from reelflow.plans.oracle import ORACLE
from tests.compare import compare, duck
from tests.conftest import SF01

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    problems, n, _ = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF01)
    assert not problems, problems
    assert n > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["video_id", "transcript", "num_segments"]
    assert df.count() > 0
