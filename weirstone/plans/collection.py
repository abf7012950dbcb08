"""Queries on collection: dedupe, windows, buffering, reshaping, landing, statistics; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from weirstone.commit import payloads
from weirstone.functions.scalar import backoff, duration_label, linear_scale, time_label
from weirstone.operators import buffer, dedupe, footprint, reshape, stats, windows
from weirstone.operators.dedupe import hour_of
from weirstone.shared import shared_path, table
from weirstone.sinks import ParquetSink, landed
from weirstone.sources.spool import closed, parsed
from weirstone.streaming.dedupe import consecutive_stream

KEY = ("user_id", "event_type")
FAILED = "tick % 7 = 3"
READING = StructType([StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("event_type", StringType()), StructField("value", DoubleType())])


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def _ticked(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("event_id", "user_id", "event_type", "value", hour_of(F.col("ts")).alias("tick"))


def dedupe_consecutive(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.consecutive(_ticked(spark, folder), KEY, position="event_id").select("event_id", "tick")


def dedupe_streaming(spark: SparkSession, folder: str) -> DataFrame:
    """The same through a stream: ticks land in four parts, which are four micro-batches in order, with state in between."""
    rows = _ticked(spark, folder).withColumnRenamed("event_id", "pos")
    root = shared_path(spark, "stream")
    ends = rows.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi")).first()
    if ends["lo"] is None:
        return rows.select(F.col("pos").alias("event_id"), "tick")
    for part in range(4):
        step = (ends["hi"] - ends["lo"]) // 4 + 1
        low = ends["lo"] + part * step
        rows.where((F.col("tick") >= low) & (F.col("tick") < low + step)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")  # goes on where the checkpoint ends
        consecutive_stream(stream, KEY).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out").select(F.col("pos").alias("event_id"), "tick")


def dedupe_in_batch(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.first_in_batch(_ticked(spark, folder), ["tick", *KEY], "event_id").select("event_id", "tick")


def dedupe_no_key(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.consecutive(_ticked(spark, folder), None).select("event_id", "tick")


def dedupe_with_failed_and_empty_ticks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ticked(spark, folder)
    polls = rows.agg(F.explode(F.sequence(F.min("tick"), F.max("tick"))).alias("tick")).withColumn("ok", ~F.expr(FAILED))
    seen = rows.join(dedupe.numbered(polls), "tick")
    return dedupe.consecutive(seen, KEY, "tick_seq", "event_id").select("event_id", "tick_seq")


def window_assign(spark: SparkSession, folder: str) -> DataFrame:
    return windows.assigned(_events(spark, folder), "ts", 600).select("event_id", "window_start", "window_end")


def window_counts(spark: SparkSession, folder: str) -> DataFrame:
    return windows.assigned(_events(spark, folder), "ts", 600).groupBy("window_start").agg(F.count("*").alias("n"))


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    return _ticked(spark, folder).groupBy("tick").agg(F.count("*").alias("n")).withColumn("pipeline", F.lit("events"))


def buffered_segments(spark: SparkSession, folder: str) -> DataFrame:
    return buffer.buffered(_batches(spark, folder), every=6, max_records=40).select("tick", "n", "segment")


def spool_segments(spark: SparkSession, folder: str) -> DataFrame:
    batches = _batches(spark, folder).withColumn("window_start", windows.align(F.col("tick"), 6))
    return buffer.spooled(batches, max_records=60).select("window_start", "tick", "n", "segment")


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.assigned(_events(spark, folder), "ts", 600).select(F.col("event_type").alias("pipeline"), "window_start").distinct()


def object_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder).withColumn("path", windows.object_path(F.col("pipeline"), F.col("window_start")))


def path_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return windows.path_collisions(_windows(spark, folder))


def last_writer_wins(spark: SparkSession, folder: str) -> DataFrame:
    return windows.last_writer(_windows(spark, folder))


def flush_order(spark: SparkSession, folder: str) -> DataFrame:
    return windows.flush_order(_windows(spark, folder))


def lookup_join(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_retailprice")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return reshape.looked_up(rows, names, "l_partkey", "p_name", "p_retailprice")


def flatten_nested(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ticked(spark, folder)
    snapshots = rows.groupBy("tick", "event_type").agg(F.collect_list(F.struct("event_id", "value")).alias("data"))
    answers = snapshots.groupBy("tick").agg(F.collect_list(F.struct("event_type", "data")).alias("readings"))
    return reshape.flattened(answers, "readings", "data")


def unpivot_regions(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    e = _events(spark, folder)
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    wide = e.groupBy(day).agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in kinds])
    return reshape.unpivoted(wide, ["day"], kinds, "region", "value")


def status_filter(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.only_ok(_events(spark, folder), F.col("event_type") != "error").select("event_id", "event_type")


def tee_union(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.branches(_events(spark, folder).select("event_id"), first=F.lit(True), second=F.lit(True))


def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    lines = _events(spark, folder).select(F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("line"))
    return parsed(lines, READING).where("ok").select("event_id", "user_id", "event_type", "value")


def torn_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    torn = F.when(F.col("event_id") % 50 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line"))
    lines = _events(spark, folder).select("event_id", line.alias("line")).select(torn.alias("line"))
    return parsed(lines, READING).where("ok").select("event_id")


def missing_field_skipped(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    line = F.to_json(F.struct("event_id", "user_id", "event_type", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value")))
    return parsed(e.select(line.alias("line")), READING).where("ok").select("event_id")


def parquet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).select("event_id", "value", "ts")
    sink = ParquetSink(spark, shared_path(spark, "landing"), e.schema)
    sink.land(e, "events", "ts")
    return landed(spark, sink.path, sink.schema).select("event_id", "value", "date", "hour")


def commit_payload(spark: SparkSession, folder: str) -> DataFrame:
    files = object_paths(spark, folder).withColumn("content", F.encode(F.concat("pipeline", F.lit("|"), "path"), "UTF-8"))
    return payloads(files, "path", "content").select("pipeline", "window_start", "payload")


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("event_id", "ts", "value")


def stats_summary(spark: SparkSession, folder: str) -> DataFrame:
    return stats.summary(_samples(spark, folder), "value")


def downsample_120(spark: SparkSession, folder: str) -> DataFrame:
    return stats.downsampled(_samples(spark, folder), ["ts", "event_id"], "value")


def peak_point(spark: SparkSession, folder: str) -> DataFrame:
    return stats.peak_point(_samples(spark, folder).select("event_id", "value"), "value", "event_id")


def duration_labels(spark: SparkSession, folder: str) -> DataFrame:
    s = (F.col("event_id") * 7).alias("s")
    return _events(spark, folder).select("event_id", s).select("event_id", duration_label(F.col("s")).alias("label"), time_label(F.col("s")).alias("time"))


def valid_samples(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    holes = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value"))
    return stats.valid(e.select("event_id", holes.alias("value")), "value").select("event_id")


def backoff_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(1, 31).select(F.col("id").alias("failures"), backoff(F.lit(1.0), F.col("id")).alias("delay_s"))


def scaled_values(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("event_id", F.round(linear_scale(F.col("value"), (0.0, 200.0), (0.0, 1.0)), 6).alias("x"))


def footprint_document(spark: SparkSession, folder: str) -> DataFrame:
    """The document's figures flat, and its chart as text."""
    e = _events(spark, folder).select("event_id", "ts", F.round("value", 2).alias("cpu"), (F.col("user_id") * 37.0).alias("rss"))
    doc = footprint.footprint(e, ["ts", "event_id"])
    chart = F.array_join(F.transform("chart", lambda p: F.concat_ws(":", p["t"].cast("string"), (p["cpu"] * 100).cast("bigint").cast("string"), F.round(p["rss"] * 10).cast("bigint").cast("string"))), ",")
    return doc.select("samples", "duration_label", F.col("cpu.avg").alias("cpu_avg"), F.col("cpu.peak").alias("cpu_peak"), F.col("rss.avg_mb").alias("rss_avg"), F.col("rss.peak_mb").alias("rss_peak"), F.size("chart").alias("points"), chart.alias("chart"))


def tick_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return stats.tick_metrics(_ticked(spark, folder), dedupe_consecutive(spark, folder))


def closed_windows(spark: SparkSession, folder: str) -> DataFrame:
    w = _windows(spark, folder)
    newest = w.groupBy("pipeline").agg(F.max("window_start").alias("active"))
    return closed(w.join(newest, "pipeline"), F.col("active")).select("pipeline", "window_start")


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_consecutive, dedupe_streaming, dedupe_in_batch, dedupe_no_key, dedupe_with_failed_and_empty_ticks, window_assign, window_counts, buffered_segments, spool_segments, object_paths, path_collisions, last_writer_wins, flush_order,
        lookup_join, flatten_nested, unpivot_regions, status_filter, tee_union, jsonl_round_trip, torn_lines, missing_field_skipped, parquet_round_trip, commit_payload, stats_summary, downsample_120, peak_point, duration_labels,
        valid_samples, backoff_schedule, scaled_values, footprint_document, tick_metrics, closed_windows,
    )
}

_T = "(select event_id, user_id, event_type, value, ts, cast(epoch_us(ts) // 3600000000 as bigint) as tick from events)"
_W = "(select distinct event_type as pipeline, make_timestamp((epoch_us(ts) // 600000000) * 600000000) as window_start from events)"
_P = f"(select pipeline, window_start, 'data/' || pipeline || '/' || strftime(window_start, '%Y-%m-%d') || '/' || strftime(window_start, '%H') || '.parquet' as path from {_W} w)"
_ONCE = f"(select * from (select *, row_number() over (partition by tick, user_id, event_type order by event_id) rn from {_T} t) where rn = 1)"
_KEPT = f"(select event_id, tick from (select *, lag(tick) over (partition by user_id, event_type order by tick) before from {_ONCE} o) where before is null or before < tick - 1)"
_B = f"(select tick, count(*) as n, row_number() over (order by tick) as i from {_T} t group by tick)"

ORACLES = {
    "dedupe_consecutive": f"select event_id, tick from {_KEPT} k",
    "dedupe_streaming": f"select event_id, tick from {_KEPT} k",
    "dedupe_in_batch": f"select event_id, tick from {_ONCE} o",
    "dedupe_no_key": f"select event_id, tick from {_T} t",
    "dedupe_with_failed_and_empty_ticks": f"""
        with t as (select * from {_T}), polls as (select unnest(range((select min(tick) from t), (select max(tick) + 1 from t))) as tick),
        l as (select tick, cast(row_number() over (order by tick) as bigint) as tick_seq from polls where tick % 7 <> 3),
        o as (select * from (select t.event_id, t.user_id, t.event_type, l.tick_seq, row_number() over (partition by tick_seq, user_id, event_type order by event_id) rn from t join l using (tick)) where rn = 1)
        select event_id, tick_seq from (select *, lag(tick_seq) over (partition by user_id, event_type order by tick_seq) before from o) where before is null or before < tick_seq - 1""",
    "window_assign": "select event_id, make_timestamp((epoch_us(ts) // 600000000) * 600000000) as window_start, make_timestamp((epoch_us(ts) // 600000000 + 1) * 600000000) as window_end from events",
    "window_counts": "select make_timestamp((epoch_us(ts) // 600000000) * 600000000) as window_start, count(*) as n from events group by 1",
    "buffered_segments": f"""
        with recursive b as materialized (select * from {_B}),
        f as (select i, tick, n, cast(0 as bigint) as segment, cast(n as bigint) as held, tick as opened, n >= 40 as fires from b where i = 1
              union all select b.i, b.tick, b.n, f.segment + case when f.fires then 1 else 0 end, case when f.fires then b.n else f.held + b.n end, case when f.fires then b.tick else f.opened end,
              (case when f.fires then b.n else f.held + b.n end) >= 40 or b.tick - (case when f.fires then b.tick else f.opened end) >= 6 from f join b on b.i = f.i + 1)
        select tick, n, segment from f""",
    "spool_segments": f"""
        with recursive b as materialized (select *, (tick // 6) * 6 as window_start, row_number() over (partition by tick // 6 order by tick) as j from {_B}),
        f as (select window_start, j, tick, n, cast(0 as bigint) as segment, cast(n as bigint) as held, n >= 60 as fires from b where j = 1
              union all select b.window_start, b.j, b.tick, b.n, f.segment + case when f.fires then 1 else 0 end, case when f.fires then b.n else f.held + b.n end,
              (case when f.fires then b.n else f.held + b.n end) >= 60 from f join b on b.window_start = f.window_start and b.j = f.j + 1)
        select cast(window_start as bigint) as window_start, tick, n, segment from f""",
    "object_paths": f"select * from {_P} p",
    "path_collisions": f"select path, count(*) as n_windows, count(*) - 1 as n_overwritten from {_P} p group by path having count(*) > 1",
    "last_writer_wins": f"select path, max(window_start) as window_start from {_P} p group by path",
    "flush_order": f"select pipeline, window_start, row_number() over (partition by pipeline order by window_start) as n from {_W} w",
    "lookup_join": "select l.l_partkey, l.l_orderkey, l.l_linenumber, coalesce(p.p_name, '') as p_name from lineitem l left join (select p_partkey, max_by(p_name, p_retailprice) as p_name from part where p_size > 25 group by p_partkey) p on p.p_partkey = l.l_partkey",
    "flatten_nested": f"select tick, event_type, event_id, value from {_T} t",
    "unpivot_regions": "select day, region, cast(count(*) filter (where event_type = region) as double) as value from (select strftime(ts, '%Y-%m-%d') as day, event_type from events) e cross join (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as region) r group by day, region",
    "status_filter": "select event_id, event_type from events where event_type <> 'error'",
    "tee_union": "select event_id, 'first' as branch from events union all select event_id, 'second' as branch from events",
    "jsonl_round_trip": "select event_id, user_id, event_type, value from events",
    "torn_lines": "select event_id from events where event_id % 50 <> 0",
    "missing_field_skipped": "select event_id from events where event_id % 10 <> 0",
    "parquet_round_trip": "select event_id, value, strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H') as hour from events",
    "commit_payload": f"""select pipeline, window_start, '{{"key":"file","value":{{"path":"' || path || '","content":"' || to_base64(encode(pipeline || '|' || path)) || '","encoding":"base64"}}}}' as payload from {_P} p""",
    "stats_summary": "select n, floor(mean * 100 + 0.5) / 100 as mean, floor(peak * 100 + 0.5) / 100 as peak, case when n * 2 >= 3600 then cast(cast(floor(n * 2 / 3600.0 + 0.5) as bigint) as varchar) || 'h' when n * 2 >= 60 then cast(cast(floor(n * 2 / 60.0 + 0.5) as bigint) as varchar) || ' min' else cast(n * 2 as varchar) || 's' end as duration from (select count(*) as n, avg(value) as mean, max(value) as peak from events)",
    "downsample_120": "select cast(min(i) * 2 as bigint) as t, floor(max(value) * 100 + 0.5) / 100 as peak, floor(avg(value) * 10 + 0.5) / 10 as mean from (select value, row_number() over (order by ts, event_id) - 1 as i, greatest(1, cast(ceil((select count(*) from events) / 120.0) as bigint)) as size from events) group by i // size",
    "peak_point": "select event_id, value from events order by value desc, event_id limit 1",
    "duration_labels": "select event_id, case when s >= 3600 then cast(cast(floor(s / 3600.0 + 0.5) as bigint) as varchar) || 'h' when s >= 60 then cast(cast(floor(s / 60.0 + 0.5) as bigint) as varchar) || ' min' else cast(s as varchar) || 's' end as label, case when s < 60 then cast(s as varchar) || 's' when s % 60 = 0 then cast(s // 60 as varchar) || 'm' else cast(s // 60 as varchar) || 'm ' || cast(s % 60 as varchar) || 's' end as time from (select event_id, event_id * 7 as s from events)",
    "valid_samples": "select event_id from events where event_id % 3 <> 0 and event_id % 5 <> 0 and value is not null and not isnan(value)",
    "backoff_schedule": "select cast(f as bigint) as failures, cast(pow(2, least(f - 1, 16)) as double) as delay_s from range(1, 31) t(f)",
    "scaled_values": "select event_id, round(value * (1.0 / 200.0), 6) as x from events",
    "footprint_document": """with e as (select round(value, 2) as cpu, user_id * 37.0::double as rss, row_number() over (order by ts, event_id) - 1 as i, (select count(*) from events) as n from events),
        p as (select min(i) * 2 as t, max(cpu) as top, floor(avg(rss) / 1024 * 10 + 0.5) as rss from e group by i // greatest(1, cast(ceil(n / 120.0) as bigint)))
        select (select count(*) from e) as samples, (select case when count(*) * 2 >= 3600 then cast(cast(floor(count(*) * 2 / 3600.0 + 0.5) as bigint) as varchar) || 'h' when count(*) * 2 >= 60 then cast(cast(floor(count(*) * 2 / 60.0 + 0.5) as bigint) as varchar) || ' min' else cast(count(*) * 2 as varchar) || 's' end from e) as duration_label,
            (select floor(avg(cpu) * 100 + 0.5) / 100 from e) as cpu_avg, (select floor(max(cpu) * 100 + 0.5) / 100 from e) as cpu_peak, (select floor(avg(rss) / 1024 * 10 + 0.5) / 10 from e) as rss_avg, (select floor(max(rss) / 1024 * 10 + 0.5) / 10 from e) as rss_peak,
            cast(count(*) as integer) as points, string_agg(cast(t as bigint) || ':' || cast(trunc(floor(top * 100 + 0.5) / 100 * 100) as bigint) || ':' || cast(rss as bigint), ',' order by t) as chart from p""",
    "tick_metrics": f"select t.tick, count(*) as fetched, coalesce(any_value(k.fresh), 0) as fresh from {_T} t left join (select tick, count(*) as fresh from {_KEPT} k group by tick) k on k.tick = t.tick group by t.tick",
    "closed_windows": f"select pipeline, window_start from (select *, max(window_start) over (partition by pipeline) as active from {_W} w) where window_start <> active",
}
