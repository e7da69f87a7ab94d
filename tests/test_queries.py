"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.comparing import connect, difference

SF = "/root/testdata/sf0.001"
NAMES = set(entry.catalogue.QUERIES)  # the corpus queries have tests of their own
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in NAMES}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(NAMES - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 20
