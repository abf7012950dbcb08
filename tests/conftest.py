import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from weirstone.shared import importable  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    importable(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


STATIONS = "seq int, station_id string, station_name string, pipeline string, interval_s int, utc_offset string"
SAMPLES = "sample_id bigint, station_id string, timestamp string, value double, window_id bigint"


@pytest.fixture(scope="session")
def stations(spark):
    rows = [(1, "S1", "a", "air_temperature", 600, "+08:00"), (2, "S20", None, "rainfall", 600, "-03:30"), (3, "S1", "b", "air_temperature", 600, "+08:00"), (4, "S300", "", "wind_speed", 3600, None)]
    return spark.createDataFrame(rows, STATIONS)
