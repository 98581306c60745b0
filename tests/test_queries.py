"""Every registered query against its SQL twin on the smallest data set."""

import pytest

from pulsewake.plans import catalogue
from pulsewake.plans.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name).startswith("ok")


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
