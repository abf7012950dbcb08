import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirstone.llm import bpe

RANKS = bpe.read_ranks()
MINE = bpe.Encoder(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BITS = ["a", "b", " ", "  ", "\n", "é", "中", "🙂", "'s", "'LL", "1", "23", "the", " the", "\r\n", "\xa0", "﻿", "ing", "½", "Ⅷ", "_", "x" * 60, "<|endoftext|>", " ", "\t", "\x00", "\x1c", "ก็", "हि"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40).map("".join))
def test_mixtures(text):
    assert MINE.encode(text) == THEIRS.encode_ordinary(text) and MINE.count(text) == len(MINE.encode(text))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    ids = MINE.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    back = {i: t for t, i in RANKS.items()}
    assert "".join(bpe.decode_stream(ids, back)) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_transducer_on_bytes(piece):
    machine = MINE.ids_of.__self__.machine
    assert machine.encode(piece) == machine.pairs.merged(piece)


def test_memo_limits_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 3)
    monkeypatch.setattr(bpe, "TRANSITIONS", 5)
    text = "The quick brown fox jumps over the lazy dog. The quick brown fox!\n" * 3
    assert bpe.Encoder(RANKS).encode(text) == THEIRS.encode_ordinary(text)


def test_stream_decoding_waits_for_whole_characters():
    back = {i: t for t, i in RANKS.items()}
    ids = MINE.encode("a🙂b")
    assert list(bpe.decode_stream(ids, back)) == ["a", "🙂", "b"]
    assert "".join(bpe.decode_stream(MINE.encode("🙂")[:1], back)) == "�"


def test_rows(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "word " * 200_000), (1, "Hello world"), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("tokens", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in bpe.p7_ids(df).collect()}
    assert got[1] == [15496, 995] and got[2] == [] and got[3] == [] and got[4] == THEIRS.encode_ordinary(rows[3][1]) and got[None] == [220]
    assert bpe.p7_ids(df).count() == 6 and bpe.p7_ids(df.limit(0)).count() == 0
    n = {r["doc_id"]: r["tokens"] for r in bpe.counted(df.drop("ids", "tokens").withColumn("tag", F.lit("x")), "tag").collect()}
    assert n[4] == len(got[4]) and n[3] == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_corpus(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.p7_ids(docs).collect():
        assert r["ids"] == THEIRS.encode_ordinary(text[r["doc_id"]] or "")
