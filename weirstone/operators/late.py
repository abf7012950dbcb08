"""Problem 3: hourly and daily aggregates by event time, corrected by late readings up to a cut-off.

Every period of a station is first published when `grace_s` have passed since its end and corrected by what arrives
until `cutoff_s`; what comes later is counted but changes nothing. Lag is `window_end` of the batch minus the end of
the period.

Readings are laid out by (station, span of event time), repeats are dropped there, and rows shrink to one partial of what
was on time per period, and one per period and late batch, before they reach Python. There each span's partials enter a
finger B-tree in order of arrival. Once the cut-off has closed all of a day (UTC), its figures are read off the inner
partials by one range query, and the day is evicted in bulk. Which of the statuses a reading has follows from its lag alone;
the tree gives the figures.

Defined results: rows without an instant or a value don't count; repeats (within 3 s of a row with a smaller
sample_id) are left out; a null window_end or pipeline rule makes a reading on time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.operators.fingertree import FingerTree, fold
from weirstone.operators.repeats import WITHIN_US, marked, with_halo
from weirstone.readings import named, readable
from weirstone.shared import dimension

PERIOD_S = 3600
SPAN_US = 14 * 86_400_000_000
DAY_S = 86_400
RAW = "sid int, period_start bigint, n_first bigint, total_first double, n_final bigint, total_final double, min_final double, max_final double, n_corrected bigint, n_cut_off bigint, n_day bigint, total_day double, min_day double, max_day double"
_NONE = (0, None, None, None)


def replay(arrivals: Iterator[tuple], period_s: int = PERIOD_S, day_s: int = DAY_S) -> Iterator[tuple]:
    """arrivals: (arrived, period, n, sum, min, max, grace, cutoff), in order of arrival, arrived null for unknown.

    Gives (period, first partial, final partial, n corrected, n cut off, final partial of the day) by period.
    """
    tree = FingerTree()
    first: dict = {}
    fixed: dict = {}
    late: dict = {}
    dropped: dict = {}
    days: dict = {}

    def close(upto: int | None) -> None:
        """Takes the days before `upto` (all for None) out of the tree."""
        while (least := tree.least()) is not None:
            day = least // day_s * day_s
            if upto is not None and day + day_s > upto:
                return
            days[day] = tree.range(day, day + day_s)
            fixed.update(tree.evict_below(day + day_s))

    for arrived, period, n, total, low, high, grace, cutoff in arrivals:
        part = [n, total, low, high]
        if arrived is None or grace is None or cutoff is None:
            first[period] = fold(first.get(period), part)
            tree.add(period, part)
            continue
        bound = arrived - cutoff - period_s  # periods that start below it are closed
        close(-(-bound // period_s) * period_s)
        if period < bound:
            dropped[period] = dropped.get(period, 0) + n
            continue
        if arrived - period - period_s > grace:
            late[period] = late.get(period, 0) + n
        else:
            first[period] = fold(first.get(period), part)
        tree.add(period, part)
    close(None)
    for period in sorted(fixed.keys() | dropped.keys()):
        yield period, first.get(period), fixed.get(period), late.get(period, 0), dropped.get(period, 0), days.get(period // day_s * day_s)


def _span(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["arrived", "period"], na_position="first", kind="stable")
    cols = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() if c in ("arrived", "grace_s", "cutoff_s") else pdf[c].tolist() for c in ("arrived", "period", "n", "total", "low", "high", "grace_s", "cutoff_s")]
    sid = pdf["sid"].iat[0]
    rows = [(sid, period, *(one or _NONE)[:2], *(fin or _NONE), n_late, n_cut, *(day or _NONE)) for period, one, fin, n_late, n_cut, day in replay(zip(*cols))]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])


def hourly(samples: DataFrame, stations: DataFrame, windows: DataFrame, pipelines: DataFrame) -> DataFrame:
    """One row per station (sid) and period with at least one usable reading, late or not: first and final figures, numbers of late readings, final figures of the day."""
    ends = dimension(windows.select("window_id", F.ceil(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz")) / 1e6).alias("arrived")).dropDuplicates(["window_id"]))
    rules = dimension(pipelines.select("pipeline", "grace_s", "cutoff_s").dropDuplicates(["pipeline"]))
    rows = readable(samples, stations).select("sid", "pipeline", "t_us", "sample_id", "value", "window_id")
    rows = with_halo(rows, SPAN_US, WITHIN_US).repartition("sid", "shard")
    kept = marked(rows).where("core and not repeat and value is not null")
    kept = kept.join(ends, "window_id", "left").join(rules, "pipeline", "left")
    period = F.floor(F.col("t_us") / (PERIOD_S * 1_000_000)) * PERIOD_S
    # what is on time comes before the cut-off can close anything of its period, so it may come as one partial, with its last batch
    on_time = (F.col("arrived") - period - PERIOD_S <= F.col("grace_s")) & (F.col("grace_s") <= F.col("cutoff_s"))
    batch = F.when(on_time, F.lit(-1).cast("bigint")).otherwise(F.col("arrived"))
    parts = kept.groupBy("sid", "shard", period.alias("period"), "grace_s", "cutoff_s", batch.alias("batch")).agg(F.max("arrived").alias("arrived"), F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    parts = parts.select("sid", "shard", "period", "arrived", "n", "total", "low", "high", "grace_s", "cutoff_s")
    raw = parts.groupBy("sid", "shard").applyInPandas(_span, RAW)
    mean = lambda of: (F.round(f"total_{of}", 6) / F.col(f"n_{of}")).alias(f"mean_{of}")
    return raw.select("sid", "period_start", "n_first", mean("first"), "n_final", mean("final"), "min_final", "max_final", "n_corrected", "n_cut_off", "n_day", mean("day"), "min_day", "max_day")


def p3_hourly(samples: DataFrame, stations: DataFrame, windows: DataFrame, pipelines: DataFrame) -> DataFrame:
    return named(hourly(samples, stations, windows, pipelines), stations)


def p3_found(samples: DataFrame, stations: DataFrame, windows: DataFrame, pipelines: DataFrame) -> DataFrame:
    h = p3_hourly(samples, stations, windows, pipelines)
    states = F.array_compact(F.array(F.when(F.col("n_corrected") > 0, "corrected"), F.when(F.col("n_cut_off") > 0, "cut_off")))
    return h.where("n_corrected > 0 or n_cut_off > 0").select("station_id", "period_start", F.explode(states).alias("status"))
