"""Every query gives the rows of its SQL."""

import pytest

from docloom import plans
from tests.compare import connection, difference


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", plans.ORACLES)
def test_same_rows_as_sql(spark, duck, sf, name):
    n, what = difference(spark, duck, plans.QUERIES[name], plans.ORACLES[name], sf)
    assert not what


def test_most_queries_find_something(spark, sf):
    assert plans.QUERIES["usage_by_user"](spark, sf).count() > 0
    assert len(plans.QUERIES) - len(plans.ORACLES) <= 6


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["userid", "name"]
    assert set(plans.QUERIES) <= set(__spark_entry__.queries()) and set(plans.ORACLES) <= set(__spark_entry__.oracle_sql())
