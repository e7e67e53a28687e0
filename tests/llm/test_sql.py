"""Registered queries against their SQL in DuckDB."""

import os

import pytest

from tabflow.llm import queries
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.SQL[name], SF) is None
