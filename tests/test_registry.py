"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("streamed_")))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLES[name], FOLDER)
    assert ok, note


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
