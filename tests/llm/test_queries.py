import glob
import os

import duckdb
import pytest
from tests.test_queries import rows_of

from weirstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    if name in queries.ORACLES:
        c = duckdb.connect()
        for f in glob.glob(f"{small}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = c.sql(queries.ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert rows_of(got, columns) == rows_of(want, columns)
