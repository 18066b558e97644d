"""Every registered query of the library against its oracle SQL on the smallest tables."""

import os

import pytest

from graphloom import catalogue

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    assert_same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], duck)
