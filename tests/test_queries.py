"""Every query that has SQL against DuckDB on the smallest tables; the others must run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from weirstone.plans import collection, core_problems

ORACLES = {**collection.ORACLES, **core_problems.ORACLES}
QUERIES = {**collection.QUERIES, **core_problems.QUERIES}


def rows_of(df, columns):
    def plain(v):
        return None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v

    return sorted(str(tuple(plain(v) for v in r)) for r in df[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert rows_of(got, columns) == rows_of(want, columns)


def test_session_zone_does_not_matter(spark, small):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    a = rows_of(core_problems.p3_found(spark, small).toPandas(), ["station_id", "period_start", "status"])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert a == rows_of(core_problems.p3_found(spark, small).toPandas(), ["station_id", "period_start", "status"])
