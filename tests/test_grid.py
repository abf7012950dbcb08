import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SAMPLES

from weirstone.operators.grid import p1_found, p1_grid, regular_grid

READ = "sid int, interval_s int, t_us bigint, value double"


def brute(points, interval, max_fill):
    """Slots, one station, by plain loops. points: (t seconds, value)."""
    slots = {}
    for t, v in points:
        slots.setdefault(int(t // interval), []).append((t / interval, v))
    ks = sorted(slots)
    x = {k: np.mean([a for a, _ in slots[k]]) for k in ks}
    y = {k: np.mean([b for _, b in slots[k]]) for k in ks}
    out = {}
    for n, k in enumerate(ks):
        out[k] = ("observed", y[k])
        if n + 1 == len(ks):
            break
        b = ks[n + 1]
        if b == k + 1:
            continue
        near = lambda p, q: q - p - 1 <= max_fill
        p = ks[n - 1] if n and near(ks[n - 1], k) else None
        c = ks[n + 2] if n + 2 < len(ks) and near(b, ks[n + 2]) else None
        h1, d1 = x[b] - x[k], (y[b] - y[k]) / (x[b] - x[k])

        def inner(h0, d0, h, d):
            if d0 * d <= 0:
                return 0.0
            w0, w1 = 2 * h + h0, h + 2 * h0
            return (w0 + w1) / (w0 / d0 + w1 / d)

        def end(h, d, h2, d2):
            m = ((2 * h + h2) * d - h * d2) / (h + h2)
            if np.sign(m) != np.sign(d):
                return 0.0
            return 3 * d if np.sign(d) != np.sign(d2) and abs(m) > 3 * abs(d) else m

        m0 = m1 = d1
        if p is not None:
            h0, d0 = x[k] - x[p], (y[k] - y[p]) / (x[k] - x[p])
            m0 = inner(h0, d0, h1, d1)
        if c is not None:
            h2, d2 = x[c] - x[b], (y[c] - y[b]) / (x[c] - x[b])
            m1 = inner(h1, d1, h2, d2)
        if p is None and c is not None:
            m0 = end(h1, d1, h2, d2)
        if c is None and p is not None:
            m1 = end(h1, d1, h0, d0)
        for q in range(k + 1, b):
            if b - k - 1 > max_fill:
                out[q] = ("gap", None)
            else:
                s = (q + 0.5 - x[k]) / h1
                out[q] = ("filled", (1 + 2 * s) * (1 - s) ** 2 * y[k] + s * (1 - s) ** 2 * h1 * m0 + s * s * (3 - 2 * s) * y[b] + s * s * (s - 1) * h1 * m1)
    return out


@pytest.mark.parametrize("shard", [4, 16, 4096])
def test_against_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    rows, want = [], {}
    for sid in range(1, 5):
        t = np.sort(rng.choice(60000, size=70 if sid > 1 else 3, replace=False)) - 5000
        v = np.round(rng.normal(size=len(t)) * 5, 2)
        rows += [(sid, 300, int(a) * 1_000_000, float(b)) for a, b in zip(t, v)]
        want |= {(sid, k * 300): x for k, x in brute(list(zip(t, v)), 300, 5).items()}
    got = {(r["sid"], r["slot_start"]): (r["status"], r["value"]) for r in regular_grid(spark.createDataFrame(rows, READ), 5, shard).collect()}
    assert got.keys() == want.keys()
    for k, (status, value) in want.items():
        assert got[k][0] == status, k
        assert (value is None and got[k][1] is None) or abs(got[k][1] - value) < 1e-6, k


def test_filled_values_stay_between_their_neighbours(spark):
    rows = [(1, 60, k * 60_000_000, float(k * k)) for k in range(40) if k % 4 != 2]
    out = {r["slot_start"] // 60: r for r in regular_grid(spark.createDataFrame(rows, READ)).collect()}
    for k, r in out.items():
        if r["status"] == "filled":
            assert out[k - 1]["value"] <= r["value"] <= out[k + 1]["value"]


def test_odd_input(spark, stations):
    assert p1_grid(spark.createDataFrame([], SAMPLES), stations).count() == 0
    rows = [(1, "S1", "1741046400", 1.0, 1), (2, "S1", "1741046400", 1.0, 1), (3, "s_1", "1741048200", None, 1), (4, "S1", "1741048200", float("nan"), 1), (5, "S1", "1741048800", 3.0, 1)]
    s = spark.createDataFrame(rows, SAMPLES).withColumn("status", F.lit("x"))
    assert {(r["station_id"], r["slot_start"]) for r in p1_found(s, stations).collect()} == {("S1", 1741047000), ("S1", 1741047600), ("S1", 1741048200)}


def test_long_gaps(spark):
    rows = [(1, 60, 0, 1.0), (1, 60, 16_725_225_600_000_000, 2.0), (2, 60, 0, 1.0), (2, 60, 60_000_000 * 9000, 2.0)]
    grid = regular_grid(spark.createDataFrame(rows, READ), shard_slots=16)
    assert grid.where("sid = 1").limit(5).count() == 5  # of 279 million slots, none of whose arrays is long
    short = grid.where("sid = 2")
    assert short.count() == 9001 == short.select("slot_start").distinct().count() and short.where("status = 'gap' and value is null").count() == 8999
