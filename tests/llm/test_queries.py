import os

import pytest

from check_queries import compare, open_tables
from siftline.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    with open_tables(FOLDER) as db:
        verdict, rows, _ = compare(spark, db, name, FOLDER)
    assert rows and verdict == ("ok" if name in SQL else "rows only")
