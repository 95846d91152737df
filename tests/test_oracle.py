"""Every registered query against its DuckDB statement, on whole small tables."""

import os

import pytest
from oracle import compare, duck

import __spark_entry__ as entry_points
from workload.queries import QUERIES
from workload.sql import ORACLES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query(spark, con, name):
    query, sql = entry_points.queries()[name], entry_points.oracle_sql()[name]
    assert compare(spark, con, query, sql, SF) is None


def test_entry(spark):
    assert entry_points.entry(spark).first()["total_rows"] > 0
