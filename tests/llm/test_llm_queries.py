"""Every registered corpus query against its SQL, or for rows, on the smallest tables."""

import pytest
from tests.comparing import connect, difference
from tests.llm.samples import SF

from tarmac.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_all_are_registered():
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 14))
