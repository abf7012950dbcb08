import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirstone.llm import mix, queries

TARGETS = "source string, target_share double, max_repeats int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 1), max_size=60), st.integers(0, 5))
def test_pivotal_keeps_the_sum(p, seed):
    out = mix.pivotal(np.array(p), np.random.default_rng(seed))
    assert abs(out.sum() - sum(p)) < 1e-6 and ((out >= 0) & (out <= 1)).all()
    assert ((out > 0) & (out < 1)).sum() <= 1


def test_pivotal_is_fair():
    p = np.array([0.1, 0.5, 0.7, 0.25, 0.45])
    mean = np.mean([mix.pivotal(p, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def _tokens(spark):
    return spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, "c").otherwise("b").alias("skey"), (F.pmod(F.xxhash64("id"), F.lit(500)) + 1).alias("tokens"))


def test_shares_and_caps(spark):
    tokens = _tokens(spark)
    targets = spark.createDataFrame([("A", 0.5, 2), ("b ", 0.3, 1), ("c", 0.2, 9)], TARGETS)
    plan = mix.demands(tokens, targets)
    m = mix.mixed(tokens, plan)
    for r in mix.shares(m, plan).collect():
        assert abs(r["share"] - r["target_share"]) < 0.002 and r["most_copies"] <= r["max_repeats"] and not r["short"]
    assert m.count() == m.select("doc_id").distinct().count()
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mix.mixed(tokens, plan).collect()))  # the same mix again


def test_many_blocks_equal_wanted_count(spark, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK_DOCS", 10)
    monkeypatch.setattr(mix, "FANOUT", 4)
    tokens = _tokens(spark).where("skey = 'a'").withColumn("tokens", F.lit(10).cast("bigint"))
    plan = mix.demands(tokens, spark.createDataFrame([("a", 1.0, 3)], TARGETS), 10 * 12345)
    assert mix.mixed(tokens, plan).agg(F.sum("copies")).first()[0] == 12345


def test_short_sources_and_odd_rows(spark):
    docs = [(1, "one two three four", "Big "), (2, "five six", "small"), (3, None, "small"), (4, "", "big"), (5, "seven eight nine", None), (6, "x", "other")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("skey", F.lit("clash")).withColumn("tokens", F.lit(0))
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 1), ("absent", 0.1, 5), ("none", None, 1)], TARGETS)
    assert {r["source"] for r in mix.p8_found(d, targets).collect()} == {"small", "absent"}
    assert mix.p8_found(d.limit(0), targets).count() == 0
    assert mix.p8_mix(d, targets).count() == 0  # an absent source can't fill any share
    assert {r["doc_id"]: r["copies"] for r in mix.mixed(mix.token_table(d), mix.demands(mix.token_table(d), targets, "all")).collect()}.get(2) == 1


def test_registered_mix_is_as_large_as_all_documents(spark, tmp_path):
    docs = [(i, "one two three four five six", "big" if i < 90 else "small") for i in range(100)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 1), ("absent", 0.1, 5)], TARGETS).write.parquet(f"{tmp_path}/mix_targets.parquet")
    shares = {r["source"]: r for r in queries.QUERIES["p8_shares"](spark, str(tmp_path)).collect()}
    assert {s: r["copies"] for s, r in shares.items()} == {"big": 60, "small": 10, "absent": 0}  # of 100 documents
    assert {s for s, r in shares.items() if r["short"]} == {"small", "absent"}
    assert abs(shares["small"]["share"] - 1 / 7) < 1e-9 and shares["absent"]["share"] == 0
    assert queries.QUERIES["p8_mix"](spark, str(tmp_path)).agg(F.sum("copies")).first()[0] == 70


def test_fill_without_sources_of_no_capacity(spark):
    tokens = _tokens(spark)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("absent", 0.2, 9)], TARGETS)
    assert {r["wanted"] for r in mix.demands(tokens, targets, "fill").collect()} == {0.0}
    plan = {r["source"]: r for r in mix.demands(tokens, targets, "fill_present").collect()}
    assert plan["a"]["wanted"] > 0 and plan["a"]["capacity"] >= plan["a"]["wanted"] and plan["b"]["capacity"] >= plan["b"]["wanted"] and plan["absent"]["capacity"] == 0
    plan = mix.demands(tokens, targets, "fill_present")
    assert {r["source"] for r in mix.shares(mix.mixed(tokens, plan), plan).where("short").collect()} == {"absent"}


def test_registered_mix_keeps_counts_caps_and_shares(spark, small):
    """On the smallest tables: each source's number of copies is the wanted sum rounded up or down, no document is beyond its cap, shares are off by at most a document's tokens."""
    documents, targets = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "mix_targets"))
    tokens = mix.token_table(documents)
    plan = mix.demands(tokens, targets, "all").cache()
    wanted = {r["source"]: r for r in plan.collect()}
    most = {r["skey"]: r["m"] for r in tokens.groupBy("skey").agg(F.max("tokens").alias("m")).collect()}
    per_doc = queries.QUERIES["p8_mix"](spark, small).join(targets.select("source", "max_repeats"), "source")
    assert per_doc.where("copies > max_repeats or copies < 1").count() == 0
    reached = {r["source"]: r for r in queries.QUERIES["p8_shares"](spark, small).collect()}
    total = sum(r["mix_tokens"] for r in reached.values())
    for source, r in reached.items():
        w = wanted[source]
        copies = w["per_doc"] * w["docs"]
        assert int(copies + 1e-6) <= r["copies"] <= int(copies + 1 - 1e-6)
        assert r["short"] == (w["capacity"] < w["wanted"]) and abs(r["share"] - r["mix_tokens"] / total) < 1e-12
        if not r["short"]:
            assert abs(r["mix_tokens"] - w["wanted"]) <= 2 * most[w["skey"]]
    assert {r["source"] for r in queries.QUERIES["p8_found"](spark, small).collect()} == {s for s, r in reached.items() if r["short"]}
