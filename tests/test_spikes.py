import numpy as np
import pytest
from tests.conftest import SAMPLES

from weirstone.operators.spikes import BIN, BINS, STAYS, cutoffs, p2_found, pareto_level, pareto_shape, peaks_of, stay_level, stays_of, unit_tails, verdicts

PIPES = "pipeline string, unit string, flush_every_s int, grace_s int, cutoff_s int"


def _pipelines(spark):
    return spark.createDataFrame([("air_temperature", "degC", 3600, 0, 0), ("rainfall", "mm", 3600, 0, 0), ("wind_speed", "m/s", 3600, 0, 0)], PIPES)


def test_planted_faults(spark, stations):
    rng = np.random.default_rng(5)
    t = 1741046400 + np.arange(6000) * 600
    air = np.round(20 + 5 * np.sin(t / 86400 * 2 * np.pi) + rng.normal(0, 0.2, 6000), 1)
    faults = set()
    air[100] += 9
    air[500:508] -= 12
    air[900] = -99.9
    air[3000:3025] = air[3000]
    faults |= {100, 900, *range(500, 508), *range(3000, 3025)}
    air[4000:] -= 6  # a front doesn't return
    rain = np.where((np.arange(6000) // 200) % 5 == 0, np.round(np.abs(rng.normal(3, 0.8, 6000)) * 5) / 5, 0.0)
    rain[2500], rain[2600] = 60.0, -0.4
    rows = [(i, "S1", str(t[i]), float(air[i]), 1) for i in range(6000)] + [(10000 + i, "S20", str(t[i]), float(rain[i]), 1) for i in range(6000)]
    rows.append((20000, "S1", str(t[100]), float(air[100]), 1))  # sent again
    got = {r["sample_id"] for r in p2_found(spark.createDataFrame(rows, SAMPLES), stations, _pipelines(spark)).collect()}
    assert got == faults | {12500, 12600, 20000}


def test_kinds_and_empty(spark, stations):
    rows = [(i, "S300", str(1741046400 + 3600 * i), 5.0 + i % 3, 1) for i in range(5)] + [(9, "S300", "1741096400", 9999.0, 1), (10, "S300", None, 9999.0, 1), (11, "S300", "1741096500", None, 1)]
    assert [(r["sample_id"], r["kind"]) for r in verdicts(spark.createDataFrame(rows, SAMPLES), stations, _pipelines(spark)).collect()] == [(9, "impossible")]
    assert p2_found(spark.createDataFrame([], SAMPLES), stations, _pipelines(spark)).count() == 0


def _hist(z):
    return np.bincount(np.minimum(np.abs(z) / BIN, BINS - 1).astype(int), minlength=BINS)


@pytest.mark.parametrize("draw, least, most", [(lambda r, n: r.normal(size=n), 3.9, 6.0), (lambda r, n: r.uniform(-2, 2, n), 1.9, 2.6), (lambda r, n: r.laplace(size=n) / 1.03, 9.0, 18.0), (lambda r, n: r.standard_t(6, n), 9.0, 60.0)])
def test_cutoffs_follow_the_risk(draw, least, most):
    """The cutoff at risk 1e-6 lies where that share of fresh draws exceeds it, to an order of magnitude, and moves with the risk; nothing clips it."""
    rng = np.random.default_rng(1)
    hist = _hist(draw(rng, 200_000))
    cut = lambda risk: pareto_level(peaks_of(hist, risk), pareto_shape(peaks_of(hist, risk)), risk) * BIN
    assert least <= cut(1e-6) <= most
    over = (np.abs(draw(rng, 4_000_000)) > cut(1e-4)).mean()
    assert 1e-5 / 3 < over < 6e-4 or (over == 0 and most < 3)
    assert cut(1e-4) < cut(1e-6) < cut(1e-8)


def test_faults_take_no_part_in_the_fit():
    rng = np.random.default_rng(3)
    z = rng.normal(size=50_000)
    clean, dirty = _hist(z), _hist(np.r_[z, rng.uniform(9, 60, 700)])
    a, b = (cutoffs(h, np.bincount([1, 1, 2], minlength=STAYS), pareto_shape(peaks_of(h)), 1.2)[0] for h in (clean, dirty))
    assert abs(a - b) < 0.7 and b < 9


def test_stays_are_the_stations_own():
    def stays(of):
        s = np.zeros(STAYS, int)
        for length, n in of.items():
            s[length] = n
        return s

    fine = stays({1: 5000, 2: 600, 3: 70, 4: 8, 5: 1, 30: 3})
    coarse = stays({40: 5000, 41: 200, 42: 20, 200: 2})
    _, mean = unit_tails(_hist(np.zeros(10)), fine + coarse, 2)
    assert 6 <= stay_level(stays_of(fine)) <= 12
    assert 44 <= stay_level(stays_of(coarse)) <= 60
    assert 6 <= cutoffs(_hist(np.zeros(10)), fine, 0.0, mean)[1] <= 30 and 43 <= cutoffs(_hist(np.zeros(10)), coarse, 0.0, mean)[1] <= 200


def test_a_station_with_long_ordinary_stays(spark, stations):
    rng = np.random.default_rng(8)
    level = np.round(20 + np.cumsum(rng.choice([-0.5, 0.5], 100)), 1)
    value = np.repeat(level, 40)
    value[1600:1840] = value[1600]
    rows = [(i, "S1", str(1741046400 + 600 * i), float(v), 1) for i, v in enumerate(value)]
    got = {r["sample_id"]: r["kind"] for r in verdicts(spark.createDataFrame(rows, SAMPLES), stations, _pipelines(spark)).collect()}
    assert {k for k, v in got.items() if v == "stuck"} == set(range(1600, 1840))
