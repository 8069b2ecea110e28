"""Every registered query against its SQL in DuckDB."""

import os

import pytest

from rankweave.plans.registry import REGISTRY
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, con, name):
    status, _, _ = compare(spark, con, SF_DIR, name)
    allowed = ("ok", "close") if REGISTRY[name].sql else ("rows=",)
    assert status.startswith(allowed), status
