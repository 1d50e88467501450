"""Every registered query against its SQL statement at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from touchline.workload import ENTRIES

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()
# corpus queries have tests of their own beside their operators
QUERIES = {name: run for name, run in entry.queries().items() if name in ENTRIES}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message, _, rows = compare(spark, con, QUERIES[name], ORACLE.get(name), FOLDER)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
