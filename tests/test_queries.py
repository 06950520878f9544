"""Every registered query: no Python in its plan, and the same result as its SQL."""

import pytest

import __spark_entry__ as driver
from checks.compare import compare, connect
from checks.queries import ORACLES, QUERIES
from tests.test_plans import plan

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = driver.queries()[name](spark, SMALL)
    text = plan(df)
    assert "CartesianProduct" not in text
    if name != "read_archives":
        assert "Python" not in text and "InPandas" not in text
    assert compare(df, con, name) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
