import os

import pytest

import __spark_entry__ as contract
from check_queries import compare, open_tables
from siftline.plans.catalog import QUERIES
from siftline.plans.oracle import SQL

FOLDER = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    with open_tables(FOLDER) as db:
        verdict, rows, _ = compare(spark, db, name, FOLDER)
    assert verdict == "ok" and rows


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry(spark):
    assert contract.entry(spark).columns == ["ts", "level", "msg", "file", "lineno"]
