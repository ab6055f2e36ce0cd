"""Every registered query of the market engine against its SQL, on the smallest tables."""

import os

import compare
import pytest

from tapeloom.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.views(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    mine, other = compare.both(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF_DIR)
    assert mine[0] == other[0]
    assert mine[1] == other[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() >= 0


def test_entry_and_names():
    import __spark_entry__ as entry

    assert entry.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
