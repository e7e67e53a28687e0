"""Every registered query against its SQL in DuckDB at the smallest scale, and the shape of its plan."""

import os

import pytest

import workload
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    frames = []

    def run(s, sf):
        frames.append(workload.QUERIES[name](s, sf))
        return frames[0]

    assert compare(spark, con, run, workload.SQL.get(name), SF) is None
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
