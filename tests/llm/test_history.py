import random

from pyspark.sql import functions as F
from tests.conftest import SAMPLES

from weirstone.llm.history import CELL_US, SPAN_CELLS, History, deduplicated, in_batches, p6_accepted, p6_found

BASE = 1741046400


def _brute(rows):
    out = set()
    for i, s, t in rows:
        if any(j < i and s2 == s and abs(t2 - t) <= 3 for j, s2, t2 in rows):
            out.add(i)
    return out


def test_against_brute_force(spark, stations):
    rng, cell = random.Random(4), CELL_US // 1_000_000
    rows = []
    for i in range(1, 500):
        near = rng.choice([0, cell, 2 * cell, SPAN_CELLS * cell, 7 * cell])
        rows.append((i, rng.choice(["S1", "S20"]), BASE - BASE % cell + near + rng.randint(-25, 25)))
    s = spark.createDataFrame([(i, st, str(t), None, 1) for i, st, t in rows], SAMPLES)
    for batches in (1, 3, 7):
        got = [r["sample_id"] for r in deduplicated(s, stations, batches).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_chain_spellings_and_unreadable(spark, stations):
    rows = [(1, "S1", str(BASE), 1.0, 1), (2, "s_1", "2025-03-04T08:00:03+08:00", 1.0, 1), (3, "S1", str(BASE + 6), 2.0, 2), (4, "S1", str(BASE + 10), 2.0, 2), (5, "S1", None, 2.0, 2), (6, "S1", None, 2.0, 2), (7, None, str(BASE), 1.0, 2), (8, "S20", str(BASE), None, 2)]
    s = spark.createDataFrame(rows, SAMPLES).withColumn("cell", F.lit(1)).withColumn("core", F.lit(1))
    assert {r["sample_id"] for r in p6_found(s, stations).collect()} == {2, 3}
    assert {tuple(r) for r in p6_accepted(s, stations).collect()} == {(1, 2, 1), (2, 6, 1)}
    assert p6_found(s.limit(0), stations).count() == 0


def test_batches_one_by_one_and_again(spark):
    h = History(spark)
    v = "sid int, t_us bigint, sample_id bigint"
    h.append(spark.createDataFrame([(1, 10_000_000, 1), (1, CELL_US - 1_000_000, 2)], v), 0)
    h.append(spark.createDataFrame([(1, 13_000_000, 3), (1, CELL_US + 2_000_000, 4), (2, 10_000_000, 5), (1, 13_000_001, 6)], v), 1)
    for _ in range(2):
        assert [r["sample_id"] for r in h.repeats(0).collect()] == []
        assert {r["sample_id"] for r in h.repeats(1).collect()} == {3, 4, 6}
    h.append(spark.createDataFrame([(1, 13_000_000, 3)], v), 1)  # a generation written again replaces itself
    assert [r["sample_id"] for r in h.repeats(1).collect()] == [3]


def test_radius_of_several_cells(spark):
    h = History(spark, radius_us=3 * CELL_US)
    v = "sid int, t_us bigint, sample_id bigint"
    h.append(spark.createDataFrame([(1, 1, 1), (2, 1, 2)], v), 0)
    h.append(spark.createDataFrame([(1, 3 * CELL_US, 3), (2, 3 * CELL_US + 2, 4), (1, 5 * CELL_US, 5)], v), 1)
    assert {r["sample_id"] for r in h.repeats(1).collect()} == {3, 5}


def test_a_further_batch_reads_what_it_touches_only(spark):
    """Cells carry centroid and radius; of a long history a batch probes the cells within its bound, however much else there is."""
    h = History(spark)
    v = "sid int, t_us bigint, sample_id bigint"
    h.append(spark.range(4000).select(F.lit(1).alias("sid"), (F.col("id") * (CELL_US // 4)).alias("t_us"), F.col("id").alias("sample_id")), 0)
    cell = h.cells().where("cell = 7").first()
    assert (cell["n"], cell["centroid"], cell["radius"]) == (4, 7 * CELL_US + 3 * CELL_US / 8, 3 * CELL_US / 8)
    new = [(1, 500 * CELL_US + 1_000_000, 5000), (1, 900 * CELL_US - 1_000_000, 5001), (1, 700 * CELL_US + CELL_US // 8, 5002), (2, 500 * CELL_US, 5003)]
    h.append(spark.createDataFrame(new, v), 1)
    assert sorted(r["cell"] for r in h.probed(1).collect()) == [500, 700, 900]  # 899 ends further away than the radius, but for 900
    assert {r["sample_id"] for r in h.repeats(1).collect()} == {5000, 5001}
    assert {tuple(r) for r in h.probed(1).select("gen", "span").collect()} == {(0, 4), (0, 5), (0, 7)}  # of 9 spans, the partitions that are read


def test_batches_are_whole_windows(spark):
    rows = spark.createDataFrame([(i, i // 7) for i in range(100)], "sample_id bigint, window_id bigint")
    parts = [[tuple(r) for r in b.collect()] for b in in_batches(rows, 3)]
    assert sum(map(len, parts)) == 100 and len(parts) == 3
    assert not {w for _, w in parts[0]} & {w for _, w in parts[1]} and not {w for _, w in parts[1]} & {w for _, w in parts[2]}
