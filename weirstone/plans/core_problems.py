"""Queries on the problems tagged general: grid, implausible values, late readings, small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.operators import compact, grid, late, spikes
from weirstone.plans.reading_sql import READINGS, REPEATS
from weirstone.shared import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return grid.p1_found(table(spark, folder, "samples"), table(spark, folder, "stations"))


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid.p1_grid(table(spark, folder, "samples"), table(spark, folder, "stations")).withColumn("value", F.round("value", 6))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.p2_found(table(spark, folder, "samples"), table(spark, folder, "stations"), table(spark, folder, "pipelines"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return late.p3_found(*(table(spark, folder, t) for t in ("samples", "stations", "windows", "pipelines")))


def p3_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return late.p3_hourly(*(table(spark, folder, t) for t in ("samples", "stations", "windows", "pipelines")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return compact.p5_found(table(spark, folder, "commits"), table(spark, folder, "windows"))


def p5_compact(spark: SparkSession, folder: str) -> DataFrame:
    return compact.compact(table(spark, folder, "commits"), table(spark, folder, "windows"))


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p3_found, p3_hourly, p5_found, p5_compact)}

_HOURS = f"""select *, us // 3600000000 * 3600 as h from r where us is not null and value is not null and sample_id not in {REPEATS}"""

ORACLES = {
    "p1_found": f"""with {READINGS}, u as (select distinct station_id, interval_s, us // (interval_s::bigint * 1000000) as slot from r where us is not null and value is not null),
        g as (select station_id, interval_s, slot, lead(slot) over (partition by station_id order by slot) as nxt from u)
        select station_id, cast(unnest(range(slot + 1, nxt)) * interval_s as bigint) as slot_start from g where nxt > slot + 1""",
    "p3_found": f"""with {READINGS}, q as (select a.station_id, a.h, epoch_us(w.window_end) / 1e6 - a.h - 3600 as lag, p.grace_s, p.cutoff_s from ({_HOURS}) a join windows w using (window_id) join pipelines p on p.pipeline = a.pipeline)
        select distinct station_id, cast(h as bigint) as period_start, case when lag > cutoff_s then 'cut_off' else 'corrected' end as status from q where lag > grace_s""",
    "p1_grid": f"""with {READINGS}, u as (select station_id, interval_s, us // (interval_s::bigint * 1000000) as slot, avg(us / 1e6 / interval_s) as x, avg(value) as v, count(*) as n from r where us is not null and value is not null group by all),
        w as (select *, lag(slot) over o as ps, lag(x) over o as px, lag(v) over o as pv, lead(slot) over o as bs, lead(x) over o as bx, lead(v) over o as bv, lead(slot, 2) over o as cs, lead(x, 2) over o as cx, lead(v, 2) over o as cv from u window o as (partition by station_id order by slot)),
        d as (select *, x - px as h0, bx - x as h1, cx - bx as h2, (v - pv) / (x - px) as d0, (bv - v) / (bx - x) as d1, (cv - bv) / (cx - bx) as d2, ps is not null and slot - ps - 1 <= {grid.MAX_FILL} as has_p, cs is not null and cs - bs - 1 <= {grid.MAX_FILL} as has_c from w),
        e as (select *, ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2) as ea, ((2 * h1 + h0) * d1 - h1 * d0) / (h1 + h0) as eb from d),
        m as (select *, case when has_p then case when d0 * d1 > 0 then (3 * h1 + 3 * h0) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) else 0 end
                when has_c then case when sign(ea) != sign(d1) then 0 when sign(d1) != sign(d2) and abs(ea) > 3 * abs(d1) then 3 * d1 else ea end else d1 end as m0,
            case when has_c then case when d1 * d2 > 0 then (3 * h2 + 3 * h1) / ((2 * h2 + h1) / d1 + (h2 + 2 * h1) / d2) else 0 end
                when has_p then case when sign(eb) != sign(d1) then 0 when sign(d1) != sign(d0) and abs(eb) > 3 * abs(d1) then 3 * d1 else eb end else d1 end as m1 from e),
        every as (select *, unnest(range(slot, coalesce(bs, slot + 1))) as k from m), placed as (select *, (k + 0.5 - x) / h1 as s from every)
        select station_id, cast(k * interval_s as bigint) as slot_start, case when k = slot then 'observed' when bs - slot - 1 <= {grid.MAX_FILL} then 'filled' else 'gap' end as status,
            round(case when k = slot then v when bs - slot - 1 <= {grid.MAX_FILL} then (1 + 2 * s) * (1 - s) * (1 - s) * v + s * (1 - s) * (1 - s) * h1 * m0 + s * s * (3 - 2 * s) * bv + s * s * (s - 1) * h1 * m1 end, 6) as value,
            case when k = slot then n else 0 end as n_readings from placed""",
    "p3_hourly": f"""with {READINGS}, q as (select a.station_id, a.h, a.value, coalesce(epoch_us(w.window_end) / 1e6 - a.h - 3600, 0) as lag, p.grace_s, p.cutoff_s from ({_HOURS}) a left join windows w using (window_id) left join pipelines p on p.pipeline = a.pipeline),
        t as (select *, lag > cutoff_s as cut, lag > grace_s and lag <= cutoff_s as late from q),
        d as (select station_id, h // 86400 as day, count(*) as n_day, round(sum(value), 6) / count(*) as mean_day, min(value) as min_day, max(value) as max_day from t where not cut group by all)
        select t.station_id, cast(h as bigint) as period_start, count(*) filter (not cut and not late) as n_first, round(sum(value) filter (not cut and not late), 6) / n_first as mean_first, count(*) filter (not cut) as n_final,
            round(sum(value) filter (not cut), 6) / n_final as mean_final, min(value) filter (not cut) as min_final, max(value) filter (not cut) as max_final, count(*) filter (late) as n_corrected, count(*) filter (cut) as n_cut_off,
            coalesce(any_value(d.n_day), 0) as n_day, any_value(mean_day) as mean_day, any_value(min_day) as min_day, any_value(max_day) as max_day
        from t left join d on d.station_id = t.station_id and d.day = t.h // 86400 group by t.station_id, h""",
    "p5_found": """with l as (select commit_id, unnest(string_split(decode(content), chr(10))) as line from commits where status = 200), v as (select distinct commit_id, cast(line ->> '$.sample_id' as bigint) as sample_id from l where json_valid(line))
        select distinct a.commit_id as commit_a, b.commit_id as commit_b from v a join v b on a.sample_id = b.sample_id and a.commit_id < b.commit_id""",
}
