import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.conftest import SAMPLES

from weirstone.llm import quantiles as Q
from weirstone.llm import queries

ROWS = "key bigint, batch bigint, value double"


def _want(values, q):
    v = np.sort(values)
    return v[max(1, int(np.ceil(q * len(v)))) - 1]


def _groups():
    rng = np.random.default_rng(2)
    return {1: rng.normal(size=9000), 2: rng.integers(0, 4, 3000).astype(float), 3: np.array([7.5]), 4: np.r_[rng.exponential(size=500), [np.inf, -np.inf, -np.inf]], 5: np.full(800, 2.0)}


@pytest.fixture
def rows(spark):
    data = [(k, int(i % 3), float(x)) for k, v in _groups().items() for i, x in enumerate(v)]
    data += [(1, 0, None), (1, 0, float("nan")), (None, 0, 1.0), (2, None, 3.0)]
    return spark.createDataFrame(data, ROWS).repartition(5)


@pytest.mark.parametrize("finish", [0, 16, 100000])
def test_exact(rows, finish):
    groups = _groups()
    groups[2] = np.r_[groups[2], 3.0]
    qs = (0.0, 0.01, 0.5, 0.77, 1.0)
    got = {(r["key"], r["q"]): (r["value"], r["n"], r["rank_error"]) for r in Q.select_ranks(Q.blocks(rows), qs, finish).collect()}
    assert got == {(k, q): (_want(v, q), len(v), 0) for k, v in groups.items() for q in qs}


def test_summaries_combine_within_their_bound(rows):
    eps = 0.01
    thin = Q.summarise(Q.blocks(rows), eps)
    a, b = thin.where("batch = 0"), thin.where("batch != 0")
    for r in Q.select_ranks(a.unionByName(b), (0.1, 0.5, 0.9), 50).collect():
        v = np.sort(np.r_[_groups()[r["key"]], [3.0] if r["key"] == 2 else []])
        rank = max(1, int(np.ceil(r["q"] * len(v))))
        low, high = np.searchsorted(v, r["value"], "left") + 1, np.searchsorted(v, r["value"], "right")
        assert r["n"] == len(v) and r["rank_error"] <= eps * len(v)
        assert low - r["rank_error"] <= rank <= high + r["rank_error"]


def test_infinities_end(spark):
    inf = float("inf")
    data = [(1, 0, x) for x in [-inf] * 4 + [inf] * 4] + [(2, 0, x) for x in (-inf, inf, 0.0)]
    got = {(r["key"], r["q"]): r["value"] for r in Q.select_ranks(Q.blocks(spark.createDataFrame(data, ROWS).repartition(3)), (0.25, 0.5, 0.51, 1.0), 1).collect()}
    assert got == {(1, 0.25): -inf, (1, 0.5): -inf, (1, 0.51): inf, (1, 1.0): inf, (2, 0.25): -inf, (2, 0.5): 0.0, (2, 0.51): 0.0, (2, 1.0): inf}


def test_summaries_of_summaries(spark):
    rng, v = np.random.default_rng(7), None
    v = rng.normal(size=40_000)
    of = Q.blocks(spark.createDataFrame([(1, i % 4, float(x)) for i, x in enumerate(v)], ROWS).coalesce(2))
    for eps in (0.004, 0.01, 0.0):
        of = Q.summarise(of, eps)
    v = np.sort(v)
    for r in Q.select_ranks(of, (0.1, 0.5, 0.9), 20).collect():
        rank = int(np.ceil(r["q"] * len(v)))
        assert r["n"] == 40_000 and 0 < r["rank_error"] <= 0.0141 * len(v)
        assert abs(np.searchsorted(v, r["value"]) + 1 - rank) <= r["rank_error"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), min_size=1, max_size=60), st.floats(0, 0.3))
def test_thinning_keeps_weight_and_ranks(pairs, eps):
    v, w = np.array(sorted(x for x, _ in pairs), float), np.array([y for _, y in pairs])
    whole = np.repeat(v, w)
    x, runs, more = Q.thinned(v, w, eps)
    assert runs.sum() == w.sum() and more <= eps * len(whole) + 0.5 and (np.diff(x) >= 0).all()
    ends = np.cumsum(runs)
    for value, end, run in zip(x, ends, runs):
        assert whole[end - run] <= value <= whole[end - 1]


def test_bound_query(spark, small):
    got = queries.QUERIES["p4_bound"](spark, small)
    assert got.count() > 0 and got.where("not holds").count() == 0


def test_hot_group_and_empty(spark):
    df = spark.range(20000).select(F.lit(1).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("batch"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("value"))
    v = [r["value"] for r in df.collect()]
    assert Q.select_ranks(Q.blocks(df), (0.5,), 10).first()["value"] == _want(np.array(v), 0.5)
    assert Q.select_ranks(Q.blocks(df.limit(0))).count() == 0


def test_stations(spark, stations):
    rows = [(1, "S1", None, 1.0, 1), (2, " s1", "x", 3.0, 1), (3, "S1", "1", None, 1), (4, "S9", "1", 5.0, 1)]
    got = Q.p4_percentiles(spark.createDataFrame(rows, SAMPLES).withColumn("n", F.lit(0)), stations).where("q = 0.5").collect()
    assert [tuple(r) for r in got] == [("S1", 0.5, 2, 1.0, 0)]
