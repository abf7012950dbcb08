import base64
import io
import json
import os
import signal
import threading
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from weirstone.commit import CommitAction, CommitResponse, CommitSink, encode, summary_of
from weirstone.functions import scalar
from weirstone.model import DownstreamError, EncodeError, FlushPolicy, RejectedError, SignalSetupError, TeeError, TransportError, WindowMeta, checked_name, object_path
from weirstone.operators import dedupe, windows
from weirstone.operators.footprint import SAMPLE as SAMPLE_OF_PROCESS
from weirstone.operators.footprint import read_samples, write_footprint
from weirstone.sinks import Buffered, DiskSpool, MemorySink, ParquetSink, Tee, landed, tee_batch
from weirstone.sources.collector import FunctionCollector, ProcessSampler, TickSource, load_config
from weirstone.sources.spool import parsed, read_segments
from weirstone.streaming.dedupe import consecutive_stream
from weirstone.streaming.flow import LandedPipeline
from weirstone.streaming.landing import Landing, hourly_writer
from weirstone.streaming.runtime import Pipeline, Supervisor, ticks

META = WindowMeta.at("p", 0, 60)


class Clock:
    def __init__(self, now=0.0):
        self.now = now

    def __call__(self):
        return self.now


def _run(collector, sink, ticks, key=None):
    left = [ticks]

    def wait(stop, seconds):
        left[0] -= 1
        return left[0] <= 0

    p = Pipeline(collector, sink, 60, key, Clock(), wait)
    p.run(threading.Event())
    return p


def test_ticks_dedupe_and_flush_on_stop():
    n = iter(range(10))

    def fetch():
        i = next(n)
        return [(i, 0), (i + 1, 0)]

    sink = MemorySink()
    _run(FunctionCollector("p", fetch), sink, 3, key=lambda r: r)
    assert sink.records() == [(0, 0), (1, 0), (2, 0), (3, 0)] and sink.flushed


def test_collect_errors_are_not_fatal_and_failed_ticks_keep_keys():
    calls = iter(range(9))

    def fetch():
        i = next(calls)
        if i % 2 == 0:
            raise OSError("down")
        return [i if i > 1 else 1]

    sink = MemorySink()
    _run(FunctionCollector("p", fetch), sink, 5)
    assert sink.records() == [1, 3]
    answers = iter([["a"], None, ["a"], [], ["a"]])

    def flaky():
        x = next(answers)
        if x is None:
            raise OSError
        return x

    sink = MemorySink()
    _run(FunctionCollector("p", flaky), sink, 5, key=lambda r: r)
    assert sink.records() == ["a", "a"]  # a failed tick keeps the keys, an empty one clears them


def test_buffered():
    clock, inner = Clock(), MemorySink()
    b = Buffered(FlushPolicy(300, 3), inner, clock)
    b.ingest(META, [1, 2])
    assert inner.batches == []
    b.ingest(META, [3])
    assert [r for _, r in inner.batches] == [[1, 2, 3]]
    b.ingest(META, [4])
    clock.now = 301
    b.ingest(META, [5])
    assert inner.batches[1][1] == [4, 5]
    inner.failing = True
    with pytest.raises(RuntimeError):
        b.ingest(META, [6, 7, 8])
    inner.failing = False
    b.ingest(META, [9])
    assert inner.batches[2][1] == [6, 7, 8, 9]


def test_tee():
    a, b = MemorySink(), MemorySink()
    Tee(a, b).ingest(META, [1])
    assert a.records() == b.records() == [1]
    a.failing = True
    with pytest.raises(TeeError) as e:
        Tee(a, b).ingest(META, [2])
    assert e.value.first and not e.value.second and b.records() == [1, 2]
    b.failing = True
    with pytest.raises(TeeError) as e:
        a.tee(b).ingest(META, [3])
    assert e.value.first and e.value.second


def test_flush_drains_the_stack():
    inner = MemorySink()
    stack = inner.buffered(FlushPolicy(3600)).buffered(FlushPolicy(3600))
    stack.ingest(META, [1, 2, 3])
    stack.flush()
    assert inner.records() == [1, 2, 3] and inner.flushed


def test_spool_is_write_ahead_and_replays(tmp_path):
    clock, inner = Clock(4000), MemorySink()
    folder = tmp_path / "air_temperature"
    spool = DiskSpool(str(folder), FlushPolicy(3600), inner, clock)
    spool.ingest(META, [{"v": 1}, {"v": 2}])
    spool.ingest(META, [{"v": 3}])
    assert inner.batches == [] and sum(len(p.read_text().splitlines()) for p in folder.glob("*.jsonl")) == 3
    again = DiskSpool(str(folder), FlushPolicy(3600), inner, clock)
    (folder / "100.jsonl").write_text('{"v": 0}\n\n{"v": 9}\n{"trunc')
    (folder / "note.jsonl").write_text("x")
    again.ingest(META, [])
    assert [r["v"] for r in inner.records()] == [0, 9, 1, 2, 3]
    assert [m.start.timestamp() for m, _ in inner.batches] == [100, 3600] and inner.batches[0][0].pipeline == "air_temperature"
    assert [p.name for p in folder.glob("*.jsonl")] == ["note.jsonl"] and (folder / "quarantine/100.jsonl").read_text() == '{"trunc\n'


def test_spool_keeps_what_downstream_refuses(tmp_path):
    clock, inner = Clock(0), MemorySink()
    spool = DiskSpool(str(tmp_path / "s"), FlushPolicy(3600, 3), inner, clock)
    inner.failing = True
    spool.ingest(META, [1, 2])
    spool.ingest(META, [3])  # accepted: it is on disk
    assert isinstance(spool.last_error, DownstreamError) and len(spool.segments()) == 2
    with pytest.raises(DownstreamError):
        spool.flush()
    inner.failing = False
    clock.now = 3700
    spool.ingest(META, [4])
    assert inner.records() == [1, 2, 3] and len(spool.segments()) == 1
    outage = MemorySink()
    outage.failing = True
    stack = outage.spooled(str(tmp_path / "t"), FlushPolicy(3600, 1), clock).buffered(FlushPolicy(0))
    stack.ingest(META, [1])
    stack.ingest(META, [2])
    outage.failing = False
    stack.flush()
    assert outage.records() == [1, 2]  # an outage makes no duplicates


def test_supervisor():
    built, sink, stop = [], MemorySink(), threading.Event()

    def factory():
        built.append(1)

        def fetch():
            if len(built) == 1:
                raise SystemError
            stop.set()
            return [1]

        class Breaks(Pipeline):
            def run(self, stop):
                if len(built) == 1:
                    raise RuntimeError("broken")
                super().run(stop)

        return Breaks(FunctionCollector("p", fetch), sink, 0.01)

    (out,) = Supervisor(base_backoff_s=0.01).pipeline(factory).run(stop)
    assert out.builds == 2 and sink.records() == [1] and sink.flushed

    def never():
        raise RuntimeError("no")

    (out,) = Supervisor(max_failures=2, base_backoff_s=0.001).pipeline(never).run()
    assert out.builds == 3 and out.gave_up
    s = Supervisor()
    assert [s.backoff(n) for n in (1, 2, 17, 40)] == [1, 2, 65536, 65536]


SAMPLE = StructType([StructField("station_id", StringType()), StructField("timestamp", StringType()), StructField("value", DoubleType())])


def test_parquet_round_trip_and_no_clobber(spark, tmp_path):
    sink = ParquetSink(spark, str(tmp_path / "d"), SAMPLE)
    a, b = WindowMeta.at("air_temperature", 1781222400, 1781223000), WindowMeta.at("air_temperature", 1781223000, 1781223600)
    sink.ingest(a, [("S100", "2026-06-12T08:00:00+08:00", 29.4), ("S117", "2026-06-12T08:00:00+08:00", 30.1)])
    sink.ingest(b, [("S100", "2026-06-12T08:10:00+08:00", 29.5)])
    sink.ingest(a, [])
    back = landed(spark, str(tmp_path / "d"), SAMPLE)
    assert back.count() == 3 and {r["hour"] for r in back.select("hour").collect()} == {"00"}
    spark.createDataFrame([], SAMPLE).write.parquet(str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).schema == SAMPLE


ARROW = pa.schema([pa.field("station_id", pa.string(), False), pa.field("value", pa.float64())])


class Remote:
    """Answers as told and keeps what it was sent."""

    def __init__(self, *answers):
        self.answers, self.sent = list(answers), []

    def send(self, request):
        answer = self.answers.pop(0) if self.answers else (200, b"{}")
        if isinstance(answer, Exception):
            raise answer
        self.sent.append(request)
        return answer


def _file_of(request):
    return [json.loads(line)["value"] for line in request.body.decode().splitlines()][1]


def test_a_commit_is_two_lines_and_hides_its_token():
    c = CommitAction("lab/tides", "draft", "t0ken-7", "why", "data/tide/1999-12-31/23.parquet", bytes(range(256)))
    r = c.request("http://remote.invalid/")
    assert r.method == "POST" and r.url.endswith("/lab/tides/commit/draft") and r.headers["authorization"].endswith("t0ken-7") and "t0ken-7" not in repr(r) + repr(c)
    lines = [json.loads(x) for x in r.body.decode().splitlines()]
    assert [x["key"] for x in lines] == ["header", "file"] and lines[0]["value"]["summary"] == "why"
    assert base64.b64decode(_file_of(r)["content"]) == bytes(range(256)) and _file_of(r)["path"].endswith("/23.parquet")
    for repo, branch in (("..", "main"), ("lab/a b", "main"), ("lab/tides", "x/y")):
        with pytest.raises(ValueError):
            CommitAction(repo, branch, "t").request("http://remote.invalid")


def test_answers():
    assert CommitAction.decode(201, b"") == CommitResponse(None, None)
    assert CommitAction.decode(200, b'{"commitOid": "77", "commitUrl": "http://remote.invalid/77", "more": 1}') == CommitResponse("http://remote.invalid/77", "77")
    for status in (199, 302, 409, 500):
        with pytest.raises(RejectedError) as e:
            CommitAction.decode(status, b"no\xfe")
        assert e.value.status == status and e.value.body == "no\ufffd"


def test_encode():
    rows = [{"station_id": "S9", "value": 0.5, "more": 1}, {"station_id": "S8"}]
    assert pq.read_table(io.BytesIO(encode(rows, ARROW))).to_pylist() == [{"station_id": "S9", "value": 0.5}, {"station_id": "S8", "value": None}]
    assert pq.read_table(io.BytesIO(encode([], ARROW))).num_rows == 0
    for bad in ([{"station_id": "S9", "value": "much"}], [{"value": 1.0}], ["text"]):
        with pytest.raises(EncodeError):
            encode(bad, ARROW)


def test_commit_sink_sends_and_says_what_failed():
    remote = Remote((200, b'{"commitOid": "1"}'), OSError("unplugged"), (503, b"later"))
    sink = CommitSink("http://remote.invalid", "lab/tides", "main", "t", ARROW, remote)
    sink.ingest(META, [])
    assert remote.sent == []
    sink.ingest(META, [{"station_id": "S9", "value": 1.0}])
    assert sink.last.commit_oid == "1" and pq.read_table(io.BytesIO(base64.b64decode(_file_of(remote.sent[0])["content"]))).num_rows == 1
    assert _file_of(remote.sent[0])["path"] == object_path(META) and json.loads(remote.sent[0].body.splitlines()[0])["value"]["summary"] == summary_of(META)
    for error in (TransportError, RejectedError):
        with pytest.raises(error):
            sink.ingest(META, [{"station_id": "S9"}])
    with pytest.raises(EncodeError):
        sink.ingest(META, [{"value": 2.0}])


def test_commit_sink_below_spool_and_tee(tmp_path):
    remote, clock, other = Remote((500, b"")), Clock(), MemorySink()
    stack = CommitSink("http://remote.invalid", "lab/tides", "main", "t", ARROW, remote).spooled(str(tmp_path / "tide"), FlushPolicy(100), clock).tee(other)
    stack.ingest(META, [{"station_id": "S1", "value": 1.0}])
    clock.now = 150
    stack.ingest(META, [{"station_id": "S2", "value": 2.0}])  # the first window is refused and stays
    clock.now = 250
    stack.ingest(META, [{"station_id": "S3", "value": 3.0}])
    stack.flush()
    got = [r["station_id"] for x in remote.sent[1:] for r in pq.read_table(io.BytesIO(base64.b64decode(_file_of(x)["content"]))).to_pylist()]
    assert got == ["S1", "S2", "S3"] and len(other.records()) == 3


def test_paths_names_windows():
    new_year = WindowMeta.at("tide", 946_681_200, 946_684_800)
    assert object_path(new_year) == "data/tide/1999-12-31/23.parquet"
    assert summary_of(new_year).count("tide") == 1 and "1999-12-31T23:00:00Z" in summary_of(new_year) and "2000-01-01T00:00:00Z" in summary_of(new_year)
    for bad in ("", ".", "..", "tide/gauge", "tide gauge", "tide\n"):
        with pytest.raises(ValueError):
            checked_name(bad)
    assert [FlushPolicy(700).align(x) for x in (-701, -700, 6, 699, 700)] == [-1400, -700, 0, 0, 700] and FlushPolicy(0.2).window_secs() == 1


def test_column_functions(spark):
    row = spark.sql("select timestamp_ntz'2001-02-03 04:05:06' as t, array(1.0D, 2.0D, 3.0D) as v").select(
        scalar.rfc3339(F.col("t")).alias("t"), *[scalar.last_part(F.lit(p)).alias(f"p{i}") for i, p in enumerate(["/a/b", "/a/b/", "c", "", "/"])],
        *[scalar.nearest(F.col("v"), F.lit(x), F.lit(10.0)).alias(f"n{i}") for i, x in enumerate([-5.0, 4.9, 5.0, 99.0])], *[scalar.spare_ratio(F.lit(x)).alias(f"s{x}") for x in (0, 3, 200)],
    ).first()
    assert list(row) == ["2001-02-03T04:05:06Z", "b", "b", "c", "unknown", "unknown", 1.0, 1.0, 2.0, 3.0, 0, 33, 0]


def test_process_sampler():
    (row,) = ProcessSampler(os.getpid()).collect()
    assert row["rss"] > 1000 and row["cpu"] >= 0 and row["ts"].endswith("Z")
    assert ProcessSampler(2**22 + 1).collect() == []


def test_signals_outside_the_main_thread():
    caught = []

    def run():
        try:
            Supervisor().run(signals=True)
        except SignalSetupError as e:
            caught.append(e)

    t = threading.Thread(target=run)
    t.start()
    t.join()
    assert len(caught) == 1


def test_signals_stop_a_supervisor():
    before = signal.getsignal(signal.SIGTERM), signal.getsignal(signal.SIGINT)
    try:
        collector = FunctionCollector("p", lambda: os.kill(os.getpid(), signal.SIGTERM) or [1])
        sink = MemorySink()
        (out,) = Supervisor().pipeline(lambda: Pipeline(collector, sink, 0.05)).run(signals=True)
        assert out.builds == 1 and sink.flushed
    finally:
        signal.signal(signal.SIGTERM, before[0])
        signal.signal(signal.SIGINT, before[1])


def test_ticks_do_not_drift():
    clock, waits = Clock(), []

    def wait(stop, seconds):
        waits.append(seconds)
        clock.now += seconds
        return len(waits) == 4

    starts = []
    for n in ticks(threading.Event(), 10, clock, wait):
        starts.append(clock.now)
        clock.now += 3 if n != 2 else 24  # the second tick misses two
    assert starts == [0, 10, 40, 50] and waits[:2] == [7, 6]


def test_footprint(spark, tmp_path):
    lines = [json.dumps({"ts": f"{i:04d}", "cpu": i % 7 + 0.125, "rss": 1024 * (i % 3)}) for i in range(250)] + ['{"ts": "x", "cpu": null, "rss": 5}', '{"cpu": 1, "r', "", '{"ts": "y", "rss": 1}']
    (tmp_path / "samples.jsonl").write_text("\n".join(lines))
    write_footprint(read_samples(spark, str(tmp_path / "samples.jsonl")), ["ts"], str(tmp_path / "out.json"))
    doc = json.loads((tmp_path / "out.json").read_text())
    assert doc["samples"] == 250 and doc["duration_label"] == "8 min" and doc["cpu"]["peak"] == 6.13 and doc["cpu"]["unit"] == "%" and doc["rss"] == {"avg_mb": 1.0, "peak_mb": 2.0}
    assert len(doc["chart"]) == 84 and doc["chart"][:2] == [{"t": 0, "cpu": 2.13, "rss": 1.0}, {"t": 6, "cpu": 5.13, "rss": 1.0}]
    with pytest.raises(FileNotFoundError):
        read_samples(spark, str(tmp_path / "none.jsonl"))
    with pytest.raises(ValueError):
        write_footprint(spark.createDataFrame([], SAMPLE_OF_PROCESS), ["ts"], str(tmp_path / "no.json"))


def test_landed_pipeline(spark, tmp_path):
    """Polls land, the stream dedupes consecutive ticks and writes hours; a pipeline built anew goes on where the last one ended."""
    schema = StructType([StructField("k", StringType()), StructField("at", TimestampType())])
    row = lambda k, hour: {"k": k, "at": f"2025-01-01T{hour:02d}:30:00Z"}
    answers = iter([[row("a", 1), row("b", 1)], OSError("down"), [row("a", 1), row("c", 2)], [], [row("a", 3)], [row("a", 3), row("d", 3)]])

    def fetch():
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    def run(polls):
        left = [polls]

        def wait(stop, seconds):
            left[0] -= 1
            return left[0] <= 0

        p = LandedPipeline(spark, FunctionCollector("p", fetch), Landing(str(tmp_path), "p"), schema, "at", str(tmp_path / "out"), 60, ("k",), every=2, clock=Clock(), wait=wait)
        Supervisor().pipeline(lambda: p).run()
        assert p.errors == []

    run(3)
    run(3)
    got = sorted((r["k"], r["tick"], r["hour"]) for r in spark.read.schema("k string, tick bigint, hour string").parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1, "01"), ("a", 4, "03"), ("b", 1, "01"), ("c", 2, "02"), ("d", 5, "03")]


def test_config():
    c = load_config('spool_dir = "s"\n[flush]\nevery = "10m"\nmax_records = 50000\n[sink.hub]\nrepo = "r"\n[collectors.rain]\ninterval = "5m"\n')
    assert (c.every_s, c.max_records, c.branch, c.interval("rain"), c.interval("other")) == (600, 50000, "main", 300, 60)


def test_segments_and_strict_lines(spark, tmp_path):
    lines = ['{"station_id":"a","value":1.0}', "", '{"station_id":"b","value":2.0}', '{"station_id":"c","val', '{"station_id":"d","value":null}', '{"station_id":"e"}', '{"station_id":"f","value":3.0,"extra":1}', '{"trunc']
    (tmp_path / "3600.jsonl").write_text("\n".join(lines))
    (tmp_path / "-7200.jsonl").write_text('{"station_id":"z","value":0.0}\n')
    (tmp_path / "x.jsonl").write_text("junk\n")
    (tmp_path / "3600.txt").write_text("junk\n")
    seg = read_segments(spark, str(tmp_path))
    got = parsed(seg, StructType([StructField("station_id", StringType()), StructField("value", DoubleType())]))
    assert [(r["window_start"], r["station_id"]) for r in got.where("ok").orderBy("window_start", "station_id").collect()] == [(-7200, "z"), (3600, "a"), (3600, "b"), (3600, "f")]
    assert got.where("not ok").count() == 4


def test_dedupe_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, None, 2), (2, None, 3), (3, "k", 4), (5, None, 5)], "tick bigint, k string, pos bigint")
    assert sorted(r["pos"] for r in dedupe.consecutive(rows, ["k"]).collect()) == [1, 4, 5]
    assert dedupe.consecutive(rows.limit(0), ["k"]).count() == 0
    assert dedupe.consecutive(rows, None).count() == 5


def test_windows_before_1970(spark):
    df = spark.sql("select timestamp_ntz'1969-12-31 23:59:59' as ts")
    assert str(windows.assigned(df, "ts", 3600).first()["window_start"]) == "1969-12-31 23:00:00"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(t, p, k) for t in range(1, 13) for p, k in enumerate("abc") if (t * 7 + ord(k) * 3) % 4]
    schema = "tick bigint, pos bigint, k string"
    src = tmp_path / "in"
    src.mkdir()
    got = []
    for part, (lo, hi) in enumerate([(1, 5), (5, 9), (9, 13)]):
        (src / f"{part}.jsonl").write_text("".join(json.dumps({"tick": t, "pos": p, "k": k}) + "\n" for t, p, k in rows if lo <= t < hi))
        stream = consecutive_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), ["k"])
        q = stream.writeStream.foreachBatch(lambda df, i: got.extend((r["tick"], r["k"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = {(r["tick"], r["k"]) for r in dedupe.consecutive(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert len(got) == len(want) and set(got) == want


def _streamed(spark, root, df, parts, keys):
    """What the stream keeps of df, a micro-batch for each range of ticks, and the number of its states after each."""
    states = []
    for lo, hi in parts:
        df.where(f"tick >= {lo} and tick < {hi}").write.mode("append").parquet(f"{root}/in")
        stream = consecutive_stream(spark.readStream.schema(df.schema).parquet(f"{root}/in"), keys)
        q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        states += [p.stateOperators[0].numRowsTotal for p in q.recentProgress]
    return sorted(map(repr, spark.read.schema(df.schema).parquet(f"{root}/out").collect())), states


def test_stream_keys_share_states(spark, tmp_path):
    """Calls and states grow with buckets, not with keys, and each part is one micro-batch."""
    rows = [(t, 1000 * t + j, i, "ab"[i % 2]) for t in range(1, 10) for j, i in enumerate(i for i in range(900) if (t * 7 + i * i) % 11 < 6)]
    df = spark.createDataFrame(rows, "tick bigint, pos bigint, u bigint, s string")
    got, states = _streamed(spark, tmp_path, df, [(1, 5), (5, 6), (6, 10)], ["u", "s"])
    assert len(states) == 3 and max(states) <= 256
    assert got == sorted(map(repr, dedupe.consecutive(df, ["u", "s"]).collect())) and 0 < len(got) < len(rows)


def test_stream_keeps_longs_whole(spark, tmp_path):
    """Longs beyond 2**53 stay whole beside nulls, of keys and of other columns, also in a micro-batch that keeps few rows; nulls and -0.0 are keys as in batch."""
    big = 1 << 60
    who = lambda i: (None if i % 97 == 0 else big + i // 2, (None, "a", "b")[i % 3], (0.0, -0.0)[i % 2])
    keys = lambda t: range(300) if t < 4 else range(302 + t)
    rows = [(t, big + 1000 * t + j, *who(i), None if i % 5 == 0 else big + i) for t in range(1, 7) for j, i in enumerate(keys(t))]
    df = spark.createDataFrame(rows, "tick bigint, pos bigint, u bigint, s string, x double, v bigint")
    got, _ = _streamed(spark, tmp_path, df, [(1, 3), (3, 4), (4, 5), (5, 7)], ["u", "s", "x"])
    assert got == sorted(map(repr, dedupe.consecutive(df, ["u", "s", "x"]).collect())) and 0 < len(got) < 400


def test_landing_to_parquet(spark, tmp_path):
    land = Landing(str(tmp_path / "l"), "rain")
    schema = StructType([StructField("id", LongType())])
    land.land([{"id": 1}, {"id": None}], 10.0)
    land.land([], 70.0)
    land.failed(OSError("x"), 130.0)
    assert land.land([{"id": 2}], 190.0) == 3 and Landing(str(tmp_path / "l"), "rain").next_tick == 4
    write = hourly_writer(str(tmp_path / "out"), "rain", "at")
    for _ in range(2):
        stream = land.stream(spark, schema).withColumn("at", F.lit("2025-03-04 01:00:00").cast("timestamp_ntz"))
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["tick"], r["id"]) for r in back.collect()) == [(1, 1), (3, 2)]
    df = spark.createDataFrame([(1, datetime(2025, 3, 4, 1))], "id bigint, at timestamp_ntz")
    hourly_writer(str(tmp_path / "twice"), "rain", "at")(df, 5)
    hourly_writer(str(tmp_path / "twice"), "rain", "at")(df, 5)
    assert spark.read.parquet(str(tmp_path / "twice")).count() == 1  # a batch that runs again replaces itself


def test_tee_batch(spark):
    got, df = [], spark.range(3)

    def bad(df, batch_id):
        raise OSError("full")

    with pytest.raises(TeeError) as e:
        tee_batch(bad, lambda df, i: got.append((i, df.count())))(df, 7)
    assert got == [(7, 3)] and isinstance(e.value.first, OSError) and e.value.second is None
    tee_batch(lambda df, i: got.append(df.count()), lambda df, i: got.append(i))(df, 8)
    assert got[1:] == [3, 8]


def test_tick_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"v": i}))
    spark.dataSource.register(TickSource)
    got = []
    q = spark.readStream.format("ticks").option("path", str(tmp_path)).load().writeStream.foreachBatch(lambda df, i: got.extend(r["tick"] for r in df.collect())).trigger(processingTime="1 second").start()
    for _ in range(40):
        if len(got) == 3:
            break
        q.processAllAvailable() if len(got) == 0 else threading.Event().wait(0.3)
    q.stop()
    assert sorted(got) == [0, 1, 2]
