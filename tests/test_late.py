import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import SAMPLES

from weirstone.operators.fingertree import FingerTree
from weirstone.operators.late import p3_found, p3_hourly, replay


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(-5, 5), st.one_of(st.none(), st.integers(0, 210))), max_size=150))
def test_tree_is_a_sorted_map_of_partials(steps):
    tree, plain = FingerTree(), {}
    for key, v, evict in steps:
        tree.add(key, [1, v, v, v])
        p = plain.setdefault(key, [0, 0, v, v])
        plain[key] = [p[0] + 1, p[1] + v, min(p[2], v), max(p[3], v)]
        if evict is not None:
            gone = {k: p for k, p in tree.evict_below(evict)}
            assert gone == {k: p for k, p in plain.items() if k < evict}
            plain = {k: p for k, p in plain.items() if k >= evict}
        assert list(tree.items()) == sorted(plain.items())
        assert tree.least() == min(plain, default=None)
        parts = [p for k, p in plain.items() if 20 <= k < 120]
        want = [sum(p[0] for p in parts), sum(p[1] for p in parts), min(p[2] for p in parts), max(p[3] for p in parts)] if parts else None
        assert tree.range(20, 120) == want


def test_large_tree():
    tree, keys = FingerTree(), random.Random(3).sample(range(10**6), 5000)
    for k in keys:
        tree.add(k, [1, k, k, k])
    assert tree.total() == [5000, sum(keys), min(keys), max(keys)]
    assert len(tree.evict_below(500_000)) == sum(k < 500_000 for k in keys)
    assert tree.total()[0] == sum(k >= 500_000 for k in keys)


def test_replay_cuts_off():
    rows = [(3600, 0, 2, 4.0, 1.0, 3.0, 60, 600), (3660, 0, 1, 5.0, 5.0, 5.0, 60, 600), (3661, 0, 1, 6.0, 6.0, 6.0, 60, 600), (4201, 0, 1, 9.0, 9.0, 9.0, 60, 600)]
    assert list(replay(iter(rows))) == [(0, [3, 9.0, 1.0, 5.0], [4, 15.0, 1.0, 6.0], 1, 1, [4, 15.0, 1.0, 6.0])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(-3, 60), st.integers(-9, 9)), max_size=120))
def test_replay_against_plain_sums(events):
    """(hour, hours late, value) against sums by hour and day of all that isn't beyond the cut-off."""
    grace, cutoff = 2 * 3600, 20 * 3600
    rows = sorted((h * 3600 + 3600 + late * 3600, h * 3600, 1, float(v), float(v), float(v), grace, cutoff) for h, late, v in events)
    kept = [(p, v) for a, p, _, v, *_ in rows if a - p - 3600 <= cutoff]
    for period, first, fin, n_late, n_cut, day in replay(iter(rows)):
        mine, whole = [v for p, v in kept if p == period], [v for p, v in kept if p // 86400 == period // 86400]
        assert (fin or [0])[0] == len(mine) and (day or [0])[0] == len(whole)
        assert not mine or fin == [len(mine), sum(mine), min(mine), max(mine)]
        assert not whole or day == [len(whole), sum(whole), min(whole), max(whole)]
        assert (first or [0])[0] + n_late == len(mine)
        assert n_cut == sum(p == period and a - p - 3600 > cutoff for a, p, *_ in rows)


def test_statuses(spark, stations):
    windows = spark.sql("select * from values (1L, timestamp_ntz'2025-03-04 01:00:00'), (2L, timestamp_ntz'2025-03-04 02:30:00'), (3L, timestamp_ntz'2025-03-04 09:00:00') t(window_id, window_end)")
    pipelines = spark.createDataFrame([("air_temperature", "degC", 3600, 3600, 14400)], "pipeline string, unit string, flush_every_s int, grace_s int, cutoff_s int")
    b = 1741046400
    rows = [(1, "S1", str(b + 60), 1.0, 1), (2, "S1", str(b + 120), 2.0, 2), (3, "S1", str(b + 180), 3.0, 3), (4, "S1", str(b + 121), 2.0, 3), (5, "S1", str(b + 7200), None, 3), (6, "S1", "x", 1.0, 3), (7, "S1", str(b + 300), 5.0, None)]
    s = spark.createDataFrame(rows, SAMPLES)
    assert {tuple(r) for r in p3_found(s, stations, windows, pipelines).collect()} == {("S1", b, "corrected"), ("S1", b, "cut_off")}
    h = p3_hourly(s, stations, windows, pipelines).first()
    assert (h["n_first"], h["n_final"], h["mean_final"], h["n_corrected"], h["n_cut_off"]) == (2, 3, 8 / 3, 1, 1)
    assert p3_found(spark.createDataFrame([], SAMPLES), stations, windows, pipelines).count() == 0
