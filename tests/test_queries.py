"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

from compare import compare, duck  # noqa: E402

from loomwork.catalog import ORACLE, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message, rows = compare(spark, con, QUERIES[name], ORACLE.get(name), FOLDER)
    assert ok, message
    assert rows > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
