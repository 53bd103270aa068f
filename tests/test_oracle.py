"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


# The columns this one keeps depend on the number of rows, which SQL text cannot follow.
LARGER = {"p_drop_sparse_cols": DATA.replace("sf0.001", "sf0.01")}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    folder = LARGER.get(name, DATA)
    source = con if folder == DATA else connect(folder)
    assert difference(QUERIES[name](spark, folder), ORACLES[name], source) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
