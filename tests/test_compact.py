import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirstone.operators import compact

COMMITS = "commit_id bigint, window_id bigint, repo string, branch string, token string, summary string, path_in_repo string, content binary, status int, committed_at timestamp_ntz"


def _file(ids, tail=b"", sep=b"\n"):
    return sep.join(json.dumps({"station_id": "S1", "sample_id": i, "timestamp": "t", "value": 1.0}).encode() for i in ids) + tail


def _commits(spark):
    files = [(1, 1, _file([1, 2, 3]), 200), (2, 1, _file([1, 2], b'\n{"sample_id": 4, "sta'), 200), (3, 2, _file([3, 5], b"\n\n\n"), 200), (4, 2, _file([1, 2, 3]), 500), (5, 2, b"", 200), (6, None, _file([9, 9]), 200), (7, 9, None, 200), (8, 2, _file([5], b"\r\n"), 200)]
    return spark.createDataFrame([(a, b, "r", "main", "redacted", None, None, c, d, None) for a, b, c, d in files], COMMITS)


def _windows(spark):
    return spark.createDataFrame([(1, "rainfall"), (2, "rainfall")], "window_id bigint, pipeline string")


def test_pairs(spark):
    assert {tuple(r) for r in compact.p5_found(_commits(spark)).collect()} == {(1, 2), (1, 3), (3, 8)}
    assert compact.p5_found(_commits(spark).limit(0)).count() == 0


def test_pairs_come_from_a_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compact, "shared_path", lambda _, name: str(tmp_path / name))
    assert {tuple(r) for r in compact.p5_found(_commits(spark), _windows(spark)).collect()} == {(1, 2), (1, 3), (3, 8)}
    assert sorted(r["sample_id"] for r in spark.read.parquet(str(tmp_path / "compacted")).collect()) == [1, 2, 3, 5, 9]


def test_every_record_once(spark, tmp_path):
    target = str(tmp_path / "out")
    report = compact.compact(_commits(spark), _windows(spark), target, 300).collect()
    back = spark.read.parquet(target)
    assert sorted(r["sample_id"] for r in back.select("sample_id").collect()) == [1, 2, 3, 5, 9]
    assert sum(r["n_files"] for r in report) == 7 and sum(r["n_records"] for r in report) == 5
    with pytest.raises(RuntimeError):
        compact.compact(_commits(spark), _windows(spark), target, 300)  # an existing target isn't touched
    assert spark.read.parquet(target).count() == 5


def test_whole_records_are_kept_and_verified(spark, tmp_path, monkeypatch):
    lines = ['{"sample_id": 1, "station_id": "S1", "timestamp": "t", "value": 1.50, "replayed": true}', '{"value": "x", "note": {"a": [1]}, "sample_id": 2}']
    content = "\n".join([*lines, '{"sample_id": 1, "station_id": "S2", "timestamp": "u", "value": 2.0}']).encode()
    commits = spark.createDataFrame([(1, 1, "r", "main", "redacted", None, None, content, 200, None)], COMMITS)
    compact.compact(commits, _windows(spark), str(tmp_path / "out"))
    back = {r["sample_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [back[i]["line"] for i in (1, 2)] == lines and (back[1]["station_id"], back[1]["value"]) == ("S1", 1.5)
    right = spark.read.schema
    changed = lambda s: type("R", (), {"parquet": lambda _, p: right(s).parquet(p).withColumn("value", F.col("value") + 1) if p.endswith(".staging") else right(s).parquet(p)})()
    monkeypatch.setattr(type(spark.read), "schema", lambda self, s: changed(s))
    with pytest.raises(RuntimeError):
        compact.compact(commits, _windows(spark), str(tmp_path / "changed"))
    assert not (tmp_path / "changed").exists()


def test_bins_are_sized_by_output(spark, tmp_path):
    """Files compress well, so a bin takes many more bytes of input than it writes, and no bin is empty of files."""
    commits = spark.createDataFrame([(i, i % 3, "r", "main", "redacted", None, None, _file(range(50 * i, 50 * i + 50)), 200, None) for i in range(200)], COMMITS)
    report = compact.compact(commits, _windows(spark), str(tmp_path / "out"), 20_000).collect()
    sizes = [sum(f.stat().st_size for f in d.glob("*.parquet")) for d in (tmp_path / "out").glob("pipeline=*/bin=*")]
    assert 2 < len(report) == len(sizes) and sum(r["n_records"] for r in report) == 10_000
    assert max(sizes) < 60_000 and max(r["bytes_in"] for r in report) > 40_000


def test_a_changed_source_is_refused(spark, tmp_path, monkeypatch):
    commits, other = _commits(spark), _commits(spark).withColumn("content", F.when(F.col("commit_id") == 8, F.lit(b"x")).otherwise(F.col("content")))
    turns = iter([compact.stored(commits), compact.stored(other)])
    monkeypatch.setattr(compact, "stored", lambda _: next(turns))
    with pytest.raises(RuntimeError, match="source"):
        compact.compact(commits, _windows(spark), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=60))
def test_first_fit_decreasing(sizes):
    bins = compact.first_fit_decreasing(np.array(sizes, dtype=np.int64), 100)
    load = {}
    for s, b in zip(sizes, bins):
        load.setdefault(int(b), []).append(s)
    assert all(sum(x) <= 100 or len([y for y in x if y]) == 1 for x in load.values())
    half = [b for b, x in load.items() if sum(x) * 2 <= 100 and sum(x)]
    assert len(half) <= 1  # two of them would have been one
