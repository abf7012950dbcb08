import pytest
from pyspark.sql import functions as F
from tests.conftest import SAMPLES

from weirstone.readings import instant_us, named, normalised, readable, station_key, usable

BASE = 1741046400  # 2025-03-04T00:00:00Z

CASES = [
    ("2025-03-04T08:00:00+08:00", BASE), ("2025-03-04T00:00:00Z", BASE), ("2025-03-04t00:00:00z", BASE), ("20250304T080000+0800", BASE), ("2025-03-04 08:00:00+08:00", BASE),
    ("2025-03-04T08:00:00.000+08:00", BASE), ("2025-03-04T08:00:00", BASE), (" 2025-03-04T08:00:00+08:00 ", BASE), (str(BASE), BASE), (str(BASE) + "000", BASE), ("2025-03-03T20:30:00-03:30", BASE),
    ("20250304T080000", BASE), ("2025-03-04T08:00:00+08", BASE), ("20250304T000000Z", BASE), ("2025-03-04 08:00:00", BASE),
    ("", None), (None, None), ("pending", None), ("NaT", None), ("n/a", None), ("1e99", None), ("--T--:--", None), ("2025-13-41T25:61:00+08:00", None), ("0000-00-00T00:00:00+08:00", None), ("2025-03", None), ("12:30", None), ("2025-02-30T00:00:00Z", None),
]


def test_instants(spark):
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
        got = {r["i"]: r["us"] for r in df.select("i", instant_us(F.col("t"), F.lit("+08:00")).alias("us")).collect()}
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for i, (text, want) in enumerate(CASES):
            assert got[i] == (None if want is None else want * 1_000_000), text


@pytest.mark.parametrize("text", [" S20", "s20", "s_20", "S 20", "S-20", "S020", "S20\t", "Ｓ20", "Ｓ２０", "s-0020"])
def test_spellings(spark, text):
    assert spark.createDataFrame([(text,)], "s string").select(station_key(F.col("s"))).first()[0] == "S20"


def test_nan_null_unknown_and_clashes(spark, stations):
    rows = [(1, "S1", str(BASE), 1.0, 1), (2, "S1", str(BASE), float("nan"), 1), (3, "S1", "x", 2.0, 1), (4, None, str(BASE), 1.0, 1), (5, "S999", str(BASE), 1.0, 1), (6, "S1", str(BASE), None, None)]
    s = spark.createDataFrame(rows, SAMPLES).withColumn("pipeline", F.lit("mine")).withColumn("interval_s", F.lit(-1)).withColumn("sid", F.lit(7))
    assert {r["sample_id"] for r in normalised(s, stations).collect()} == {1, 2, 3, 6}
    assert {r["sample_id"] for r in readable(s, stations).collect()} == {1, 2, 6}
    got = usable(s, stations).collect()
    assert [(r["sample_id"], r["pipeline"], r["interval_s"]) for r in got] == [(1, "air_temperature", 600)]
    assert named(usable(s, stations), stations).first()["station_id"] == "S1"
    assert usable(spark.createDataFrame([], SAMPLES), stations).count() == 0
