from types import SimpleNamespace

import pytest

from weirstone.shared import dimension, shared_root


def test_a_cluster_must_name_its_shared_folder():
    unset = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(RuntimeError):
        shared_root(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))
    named = SimpleNamespace(get=lambda name, default: "hdfs:///shared/")
    assert shared_root(SimpleNamespace(conf=named, sparkContext=SimpleNamespace(master="yarn"))) == "hdfs:///shared"


def test_only_what_is_proven_small_is_broadcast(spark):
    df = spark.createDataFrame([(1, "x" * 1000, [1.0] * 50), (2, None, None)], "a int, b string, c array<double>")
    assert dimension(df) is not df
    assert dimension(df, limit=1) is df
    assert dimension(df, limit_bytes=1500) is df and dimension(df, limit_bytes=2500) is not df
    assert dimension(df.limit(0), limit=0, limit_bytes=0) is not df
