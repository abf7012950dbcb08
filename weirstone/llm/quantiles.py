"""Problem 4: percentiles per group by distributed multi-select, with summaries that combine.

Every input partition sorts its own values by group into blocks (no shuffle of values). Then, for each group and
percentile, each partition proposes the weighted median of its blocks' medians of what they still have between the
bounds, the weighted median of the proposals (a value that occurs, never one between two) becomes the pivot, all blocks
count three ways (less, equal, greater), and the side that can't hold the rank is ruled out, the pivot with it, so every
turn ends with less. One pass does both: it counts for this pivot and proposes for either outcome; it shuffles one row
per partition, group and percentile. When at most `finish` values are left
of a group, they are gathered and the rank is read off. Every few passes the blocks are rewritten without what is ruled
out, so the data that passes read shrinks geometrically. A hot group is many blocks, never one task's.

`summarise` thins blocks, already thinned ones too, to weighted values with rank error at most eps * n more; blocks of
several days or batches combine by union and go through the same selection. `rank_error` in the results is the bound (0 for unthinned blocks).

The percentile q of n values is the one of rank max(1, ceil(q * n)) in ascending order. Defined results: null and NaN
values don't count, a null group is left out, infinities sort at the ends, ties count one by one, an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.readings import station_dim, station_key
from weirstone.shared import dimension, written

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
BLOCK_ROWS = 1 << 20
FINISH = 4096
REWRITE_EVERY = 3
#: Medians of blocks that a task holds before it tells its proposals.
PENDING = 100_000
BLOCK = "key bigint, batch bigint, vals array<double>, wts array<bigint>, err bigint"
_BLOCK = pa.schema([("key", pa.int64()), ("batch", pa.int64()), ("vals", pa.list_(pa.float64())), ("wts", pa.list_(pa.int64())), ("err", pa.int64())])


def _emit(keys: np.ndarray, batches: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((values, batches, keys))
    k, b, v = keys[order], batches[order], values[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(k) != 0) | (np.diff(b) != 0)])
    ends = np.r_[cut, len(k)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(v))
    return pa.RecordBatch.from_arrays([pa.array(k[cut]), pa.array(b[cut]), lists, pa.nulls(len(cut), pa.list_(pa.int64())), pa.array(np.zeros(len(cut), np.int64))], schema=_BLOCK)


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield _flush(held)
            held, n = [], 0
    if n:
        yield _flush(held)


def _flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    return _emit(*(t[c].to_numpy() for c in ("key", "batch", "value")))


def blocks(rows: DataFrame) -> DataFrame:
    """rows: key bigint, batch bigint, value double. One row per input partition, key and batch, with its sorted values."""
    rows = rows.where("key is not null and value is not null and not isnan(value)").select("key", F.coalesce("batch", F.lit(-1)).alias("batch"), "value")
    return written(rows.mapInArrow(_sorted_blocks, BLOCK), "blocks")


def thinned(v: np.ndarray, w: np.ndarray | None, eps: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The middles of runs of 2*eps*n (by weight) of ascending v, the runs' weights, and the rank error that adds."""
    cum = np.arange(len(v) + 1) if w is None else np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    n = int(cum[-1])
    step = max(1, int(2 * eps * n))
    starts = np.arange(0, n, step)
    runs = np.minimum(step, n - starts)
    return v[np.searchsorted(cum, starts + runs // 2, "right") - 1], runs.astype(np.int64), step // 2


def summarise(of: DataFrame, eps: float) -> DataFrame:
    """Thins each block; adds at most eps*n to its rank error."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vals, wts, errs = [], [], []
            for v, w, err in zip(batch["vals"], batch["wts"], batch["err"].to_pylist()):
                x, runs, more = thinned(v.values.to_numpy(), w.values.to_numpy() if w.is_valid else None, eps)
                vals.append(x)
                wts.append(runs)
                errs.append(err + more)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["batch"], pa.array(vals, pa.list_(pa.float64())), pa.array(wts, pa.list_(pa.int64())), pa.array(errs, pa.int64())], schema=_BLOCK)

    return of.mapInArrow(thin, BLOCK)


def _bounds(v: np.ndarray, lo, hi) -> tuple[int, int]:
    return (0 if lo is None else int(np.searchsorted(v, lo, "right"))), (len(v) if hi is None else int(np.searchsorted(v, hi, "left")))


def _median(v: np.ndarray, cum: np.ndarray | None, i: int, j: int) -> tuple[float | None, int]:
    """The weighted median of v[i:j] and the weight; cum[k] is the weight of v[:k]."""
    if j <= i:
        return None, 0
    if cum is None:
        return float(v[(i + j - 1) // 2]), j - i
    w = int(cum[j] - cum[i])
    return float(v[min(j - 1, int(np.searchsorted(cum, cum[i] + (w + 1) // 2)) - 1)]), w


_PASS = pa.schema([("key", pa.int64()), ("q", pa.float64()), ("less", pa.int64()), ("same", pa.int64()), ("more", pa.int64()), ("low_mid", pa.float64()), ("low_w", pa.int64()), ("high_mid", pa.float64()), ("high_w", pa.int64()), ("held", pa.int64())])


def _proposal(medians: list[tuple[float, int]]) -> tuple[float | None, int]:
    """The weighted median of medians, and their weight."""
    if not medians:
        return None, 0
    mids, w = np.array([m for m, _ in medians]), np.array([x for _, x in medians], dtype=np.int64)
    order = np.argsort(mids, kind="stable")
    cum = np.cumsum(w[order])
    return float(mids[order][np.searchsorted(cum, (cum[-1] + 1) // 2)]), int(cum[-1])


def _told(held: dict) -> pa.RecordBatch:
    rows = [(*k, less, same, more, *_proposal(lows), *_proposal(highs), n) for k, (less, same, more, n, lows, highs) in held.items()]
    return pa.RecordBatch.from_pylist([dict(zip(_PASS.names, r)) for r in rows], schema=_PASS)


def _count_three_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}
    pending = 0
    for batch in batches:
        state = [batch[c].to_pylist() for c in ("key", "q", "lo", "hi", "pivot")]
        for at, (key, q, lo, hi, pivot) in enumerate(zip(*state)):
            v = batch["vals"][at].values.to_numpy()
            w = batch["wts"][at]
            cum = np.concatenate([[0], np.cumsum(w.values.to_numpy(), dtype=np.int64)]) if w.is_valid else None
            i, j = _bounds(v, lo, hi)
            a, b = (i, i) if pivot is None else (i + int(np.searchsorted(v[i:j], pivot, "left")), i + int(np.searchsorted(v[i:j], pivot, "right")))
            of = sums.setdefault((key, q), [0, 0, 0, 0, [], []])
            for side, x, y in ((4, i, a), (5, b, j)):
                mid, weight = _median(v, cum, x, y)
                of[0 if side == 4 else 2] += weight
                if weight:
                    of[side].append((mid, weight))
                    pending += 1
            of[1] += b - a if cum is None else int(cum[b] - cum[a])
            of[3] += j - i
        if pending > PENDING:
            yield _told(sums)
            sums, pending = {}, 0
    yield _told(sums)


def _weighted_median(mid: str, weight: str) -> Column:
    """Of the proposals of all partitions the weighted lower median; one pair a partition, group and percentile."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(weight) > 0, F.struct(F.col(mid).alias("m"), F.col(weight).alias("w")))))
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + x["w"])
    start = F.struct(F.lit(0).cast("bigint").alias("cum"), F.lit(None).cast("double").alias("m"))
    step = lambda a, x: F.struct((a["cum"] + x["w"]).alias("cum"), F.when(a["m"].isNull() & (2 * (a["cum"] + x["w"]) >= total), x["m"]).otherwise(a["m"]).alias("m"))
    return F.aggregate(pairs, start, step)["m"]


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the bounds leave of each block, for one percentile."""
    schema = pa.schema([("key", pa.int64()), ("q", pa.float64()), ("vals", pa.list_(pa.float64())), ("wts", pa.list_(pa.int64()))])
    for batch in batches:
        keys, qs, vals, wts = [], [], [], []
        for at, (key, q, lo, hi) in enumerate(zip(*(batch[c].to_pylist() for c in ("key", "q", "lo", "hi")))):
            v, w = batch["vals"][at].values.to_numpy(), batch["wts"][at]
            i, j = _bounds(v, lo, hi)
            if j > i:
                keys.append(key)
                qs.append(q)
                vals.append(v[i:j])
                wts.append(w.values.to_numpy()[i:j] if w.is_valid else None)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(qs, pa.float64()), pa.array(vals, pa.list_(pa.float64())), pa.array(wts, pa.list_(pa.int64()))], schema=schema)


def _finish(rows: pa.Table) -> pa.Table:
    v = np.concatenate([x.values.to_numpy() for x in rows["vals"]])
    w = np.concatenate([x.values.to_numpy() if x.is_valid else np.ones(len(y), np.int64) for x, y in zip(rows["wts"], rows["vals"])])
    order = np.argsort(v, kind="stable")
    at = int(np.searchsorted(np.cumsum(w[order]), rows["rank"][0].as_py()))
    return pa.table({"key": [rows["key"][0].as_py()], "q": [rows["q"][0].as_py()], "value": [float(v[order][min(at, len(v) - 1)])]}, schema=pa.schema([("key", pa.int64()), ("q", pa.float64()), ("value", pa.float64())]))


def select_ranks(of: DataFrame, quantiles: Sequence[float] = QUANTILES, finish: int = FINISH) -> DataFrame:
    """of: blocks of any number of days or batches. Gives key, q, n, value, rank_error."""
    weight = F.expr("case when wts is null then size(vals) else aggregate(wts, 0L, (a, x) -> a + x) end").cast("bigint")
    n = of.groupBy("key").agg(F.sum(weight).alias("n"), F.sum("err").alias("rank_error"))
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles])).alias("q")
    state = n.select("key", "n", "rank_error", q).withColumn("rank", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("q") * F.col("n"))))
    none = F.lit(None).cast("double")
    state = written(state.select("key", "q", "n", "rank_error", "rank", none.alias("lo"), none.alias("hi"), none.alias("pivot"), none.alias("value"), F.lit(None).cast("bigint").alias("held")), "ranks")
    data, on, turn, before = of.select("key", "vals", "wts"), ["key"], 0, None
    while True:
        open_ = state.where(f"value is null and (held is null or held > {finish})")
        left = open_.agg(F.count("*").alias("n"), F.sum("held").alias("held")).first()
        if not left["n"]:
            break
        if turn > 2 and left == before:  # held is what was left before the turn
            raise RuntimeError(f"the selection came to a stop with {left} after {turn} turns")
        before = left
        if turn and turn % REWRITE_EVERY == 0:
            live = state.where("value is null").select("key", "q", "lo", "hi")
            data, on = written(data.join(dimension(live), on).select("key", "q", "lo", "hi", "vals", "wts").mapInArrow(_left, "key bigint, q double, vals array<double>, wts array<bigint>"), "left"), ["key", "q"]
        told = data.join(dimension(open_.select("key", "q", "lo", "hi", "pivot")), on).select("key", "q", "lo", "hi", "pivot", "vals", "wts").mapInArrow(_count_three_ways, "key bigint, q double, less bigint, same bigint, more bigint, low_mid double, low_w bigint, high_mid double, high_w bigint, held bigint")
        sums = told.groupBy("key", "q").agg(
            F.sum("less").alias("less"), F.sum("same").alias("same"), F.sum("held").alias("at"),
            _weighted_median("low_mid", "low_w").alias("low_pivot"), _weighted_median("high_mid", "high_w").alias("high_pivot"),
        )
        s = state.join(sums, ["key", "q"], "left")
        r, less, upto = F.col("rank"), F.col("less"), F.col("less") + F.col("same")
        asked, went_low, hit = less.isNotNull(), F.col("pivot").isNotNull() & (r <= less), F.col("pivot").isNotNull() & (r > less) & (r <= upto)
        rest = asked & ~went_low & ~hit
        state = written(
            s.select(
                "key", "q", "n", "rank_error",
                F.when(rest, r - upto).otherwise(r).alias("rank"),
                F.when(rest & F.col("pivot").isNotNull(), F.col("pivot")).otherwise(F.col("lo")).alias("lo"),
                F.when(asked & went_low, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
                F.when(asked & went_low, F.col("low_pivot")).when(rest, F.col("high_pivot")).otherwise(F.col("pivot")).alias("pivot"),
                F.when(asked & hit, F.col("pivot")).otherwise(F.col("value")).alias("value"),
                F.when(asked, F.col("at")).otherwise(F.col("held")).alias("held"),
            ),
            "ranks",
        )
        turn += 1
    live = state.where("value is null").select("key", "q", "rank", "lo", "hi")
    left = data.join(dimension(live.drop("rank")), on).select("key", "q", "lo", "hi", "vals", "wts").mapInArrow(_left, "key bigint, q double, vals array<double>, wts array<bigint>")
    last = left.join(dimension(live.select("key", "q", "rank")), ["key", "q"]).groupBy("key", "q").applyInArrow(_finish, "key bigint, q double, value double")
    return state.select("key", "q", "n", "rank_error", "value").join(last.withColumnRenamed("value", "late"), ["key", "q"], "left").select("key", "q", "n", F.coalesce("value", "late").alias("value"), "rank_error")


def _by_station(samples: DataFrame, stations: DataFrame, windows: DataFrame | None) -> DataFrame:
    dim = dimension(station_dim(stations).select("sid", "skey"))
    rows = samples.select(station_key(F.col("station_id")).alias("skey"), "value", "window_id").join(dim, "skey")
    if windows is None:
        return rows.select(F.col("sid").cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("batch"), "value")
    days = dimension(windows.select("window_id", F.unix_date(F.to_date("window_start")).cast("bigint").alias("day")).dropDuplicates(["window_id"]))
    return rows.join(days, "window_id", "left").select(F.col("sid").cast("bigint").alias("key"), F.col("day").alias("batch"), "value")


def _with_names(of: DataFrame, stations: DataFrame) -> DataFrame:
    dim = dimension(station_dim(stations).select(F.col("sid").cast("bigint").alias("key"), F.col("station").alias("station_id")))
    return of.join(dim, "key").select("station_id", "q", "n", "value", "rank_error")


def p4_percentiles(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """Exact percentiles of each station's values: all rows with a value, readable timestamp or not."""
    return _with_names(select_ranks(blocks(_by_station(samples, stations, None))), stations)


def p4_combined(samples: DataFrame, stations: DataFrame, windows: DataFrame, eps: float = 0.005) -> DataFrame:
    """The same from summaries made day by day (of arrival) with eps each, and combined."""
    return _with_names(select_ranks(summarise(blocks(_by_station(samples, stations, windows)), eps)), stations)


def p4_bound(samples: DataFrame, stations: DataFrame, windows: DataFrame, eps: float = 0.005) -> DataFrame:
    """p4_combined held against exact ranks: station_id, q, n, holds (the value's ranks lie within rank_error of the wanted one, and that within eps * n)."""
    got = written(select_ranks(summarise(blocks(_by_station(samples, stations, windows)), eps)), "combined")
    answers = got.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("q", "n", "value", "rank_error"))).alias("a"))
    rows = _by_station(samples, stations, None).where("value is not null and not isnan(value)").join(dimension(answers), "key")
    at = lambda i: F.col("a")[i]["value"]
    exact = rows.groupBy("key").agg(F.first("a").alias("a"), *[F.count(F.when(F.col("value") < at(i), 1)).alias(f"less{i}") for i in range(len(QUANTILES))], *[F.count(F.when(F.col("value") <= at(i), 1)).alias(f"upto{i}") for i in range(len(QUANTILES))])
    one = [F.struct(F.col("a")[i].alias("r"), F.col(f"less{i}").alias("less"), F.col(f"upto{i}").alias("upto")) for i in range(len(QUANTILES))]
    r = exact.select("key", F.explode(F.array(*one)).alias("x")).select("key", "x.r.*", "x.less", "x.upto")
    rank, err = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("q") * F.col("n"))), F.col("rank_error")
    holds = (F.col("less") + 1 - err <= rank) & (rank <= F.col("upto") + err) & (err <= eps * F.col("n"))
    dim = dimension(station_dim(stations).select(F.col("sid").cast("bigint").alias("key"), F.col("station").alias("station_id")))
    return r.withColumn("holds", holds).join(dim, "key").select("station_id", "q", "n", "holds")
