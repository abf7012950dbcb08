"""Problem 2: implausible values, stuck instruments and spikes, each against the station's own normal behaviour.

One pass over (station, time shard), each with a halo of neighbouring readings, computes in numpy for every reading:
- the residual against its course: the value less the station's seasonal profile (median by hour of day), less the
  running median of `2*HALF+1` readings, divided by the shard's own spread; rain, whose noise grows with the amount
  and which has long dry spells, is not deseasonalised and is divided by 1 + 0.25 * course first;
- how far it stands off the readings on both sides that are themselves on course (a front doesn't return, a spike does);
- how long its value has stayed unchanged.
The pass gives only the readings worth a look and sparse histograms of residuals and stays per shard. Summed per station
in the JVM, both get a tail by peaks over a threshold, with what can't be of the tail left out first (`settled`):
- residuals: a generalised Pareto distribution, whose shape (probability weighted moments) is that of all stations of the
  unit, as a few hundred peaks don't give a shape, and whose threshold and scale are the station's own. The cutoff is the
  deviation that one reading in 1/RISK exceeds;
- stays: a geometric distribution beyond the station's own threshold, its mean weighed with that of the unit. A stay is a
  fault from the length that FALSE_STAYS of all the station's stays would reach.
Neither cutoff is clipped. Values outside the quantity's possible range are faults at once.

Defined results: null and NaN values and unreadable timestamps are never flagged; repeated rows share the verdict
of their reading; a station with a handful of readings goes by its unit's tail; an unknown unit has no range. Readings on course within
WATCH spreads and stays below LEAST_STAY readings are never looked at, so cutoffs below them (risks above 1e-4) act as they
do; of a stay longer than the halo, what lies within a shard and its halo counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.operators.repeats import with_halo
from weirstone.readings import usable
from weirstone.shared import dimension, written

#: Possible values by unit: least, most.
POSSIBLE = {"degC": (-60.0, 57.0), "mm": (0.0, 300.0), "percent": (0.0, 100.0), "m/s": (0.0, 113.0)}
#: Units whose noise grows with the value and whose zero is ordinary weather.
SHOWERY = ("mm",)
RISK = 1e-8
FALSE_STAYS = 0.01
#: Share of a station's residuals, and of its stays, beyond the threshold.
PEAKS = 0.05
#: How many stays beyond the threshold the unit's mean weighs as.
PRIOR = 10.0
HALF = 12
#: Spreads up to which a reading is on course, and from which it is looked at.
CALM, WATCH = 4.0, 3.5
LEAST_STAY = 4
#: Stays this long, and three times as long as nearly all of the shard, take no part in finding the course.
HELD = 12
SHARD_READINGS = 2048
HALO_READINGS = 96
BIN, BINS, STAYS = 0.1, 400, 512
_SCHEMA = pa.schema([("sid", pa.int32()), ("unit", pa.string()), ("sample_id", pa.int64()), ("z", pa.float64()), ("stay", pa.int32()), ("bad", pa.bool_()), ("bins", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
OUT = "sid int, unit string, sample_id bigint, z double, stay int, bad boolean, bins array<int>, counts array<bigint>"


def _running_median(x: np.ndarray, half: int) -> np.ndarray:
    n = len(x)
    k = min(half, n - 1)
    if k <= 0:
        return x.copy()
    padded = np.concatenate([x[k:0:-1], x, x[-2 : -k - 2 : -1]])
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * k + 1), axis=1)


def _sides(x: np.ndarray, calm: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each reading the median of the nearest calm readings before and after it (nan where there is none)."""
    idx = np.flatnonzero(calm)
    before, after = np.full(len(x), np.nan), np.full(len(x), np.nan)
    at = np.searchsorted(idx, np.arange(len(x)))
    for i in np.flatnonzero(~calm):
        b, a = idx[max(0, at[i] - width) : at[i]], idx[at[i] : at[i] + width]
        if len(b):
            before[i] = np.median(x[b])
        if len(a):
            after[i] = np.median(x[a])
    return before, after


def judge(t_us: np.ndarray, value: np.ndarray, season: np.ndarray, low: float, high: float, showery: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of readings in order of time: deviation z (inf outside the possible range), length of the stay, bad, first row of its reading."""
    n = len(value)
    first = np.r_[True, (np.diff(t_us) > 3_000_000) | (np.diff(value) != 0)]
    of = np.cumsum(first) - 1
    v, s = value[first], season[first]
    change = np.r_[True, np.diff(v) != 0]
    run = np.cumsum(change) - 1
    stay = np.bincount(run)[run]
    dry = showery & (v == 0)
    stay = np.where(dry, 1, stay)
    bad = (v < low) | (v > high)
    x = v if showery else v - s
    use = ~bad & (stay < max(HELD, 3 * np.quantile(stay[change], 0.99) if n else 0))
    z = np.zeros(len(v))
    if use.sum() >= 3:
        y = x[use]
        course = _running_median(y, HALF)
        unit = 1 + 0.25 * np.abs(course) if showery else np.ones(len(y))
        r = (y - course) / unit
        moving = (y != 0) if showery else np.ones(len(y), bool)
        spread = 1.4826 * np.median(np.abs(r[moving])) if moving.any() else 0.0
        coarse = showery or np.array_equal(v[use], np.round(v[use]))
        spread = max(spread, 0.3 if coarse else 0.05)
        q = r / spread
        calm = np.abs(q) <= CALM
        before, after = _sides(y, calm)
        hot = ~calm
        for side in (before, after):
            d = (y[hot] - side[hot]) / unit[hot] / spread
            d = np.where(np.isnan(d), q[hot], d)
            same = np.sign(d) == np.sign(q[hot])
            q[hot] = np.where(same, np.sign(q[hot]) * np.minimum(np.abs(q[hot]), np.abs(d)), 0.0)
        z[use] = q
    return z[of], stay[of], bad[of], first if n else np.zeros(0, bool)


def _pass(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("t_us", "ascending"), ("sample_id", "ascending")])
    core, value, t_us, season = (rows[c].to_numpy() for c in ("core", "value", "t_us", "season"))
    sid, unit = rows["sid"][0].as_py(), rows["unit"][0].as_py()
    low, high = POSSIBLE.get(unit, (-np.inf, np.inf))
    z, stay, bad, first = judge(t_us, value, season.astype(float), low, high, unit in SHOWERY)
    own = core & first
    look = core & (bad | (np.abs(z) > WATCH) | (stay >= LEAST_STAY))
    n, extra = int(look.sum()), int(own.any())
    hist = np.bincount(np.minimum(np.abs(z[own & ~bad]) / BIN, BINS - 1).astype(int), minlength=BINS)
    stays = np.bincount(np.minimum(stay[own & np.r_[True, np.diff(value) != 0]], STAYS - 1), minlength=STAYS)
    both = np.concatenate([hist, stays])
    bins = np.flatnonzero(both)
    nothing = [None] * extra
    columns = {
        "sid": [sid] * (n + extra), "unit": [unit] * (n + extra), "sample_id": rows["sample_id"].to_numpy()[look].tolist() + nothing, "z": np.abs(z[look]).tolist() + nothing, "stay": stay[look].tolist() + nothing, "bad": bad[look].tolist() + nothing,
        "bins": [None] * n + [bins.tolist()] * extra, "counts": [None] * n + [both[bins].tolist()] * extra,
    }
    return pa.table(columns, schema=_SCHEMA)


def _peaks(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """The threshold, the first bin beyond 1 - PEAKS of all, and the counts from it on."""
    u = int(np.searchsorted(np.cumsum(counts), (1 - PEAKS) * counts.sum())) + 1
    return u, counts[u:].astype(float)


def _median_excess(counts: np.ndarray) -> tuple[int, float]:
    u, w = _peaks(counts)
    return u, float(np.searchsorted(np.cumsum(w), 0.5 * w.sum())) + 0.5 if w.sum() else 0.5


def settled(counts: np.ndarray, start: float, level: Callable[[np.ndarray], float]) -> np.ndarray:
    """counts without the bins from `start` on, then without those from the level of the rest on, until that stays the same. Faults are what lies beyond."""
    top = start
    for _ in range(30):
        body = np.where(np.arange(len(counts)) < top, counts, 0)
        new = level(body)
        if abs(new - top) < 0.5:
            break
        top = new
    return body


def pareto_shape(hist: np.ndarray) -> float:
    """Shape of the generalised Pareto distribution of the peaks, by probability weighted moments, and two standard errors to the safe side; 0 (exponential) for too few."""
    _, w = _peaks(hist)
    k = w.sum()
    if k < 50:
        return 0.0
    over = np.arange(len(w)) + 0.5
    mean = (over * w).sum() / k
    a1 = (over * w * (1 - (np.cumsum(w) - 0.5 * w) / k)).sum() / k
    return float(2 - mean / (mean - 2 * a1) + 2 / np.sqrt(k)) if mean > 2 * a1 else 0.0


def pareto_level(hist: np.ndarray, shape: float, risk: float = RISK) -> float:
    """The bin that a residual exceeds with probability `risk`, from the peaks of a histogram, their scale two standard errors to the safe side."""
    u, w = _peaks(hist)
    k = w.sum()
    if not k:
        return float(u)
    scale = ((np.arange(len(w)) + 0.5) * w).sum() / k * (1 - shape) * (1 + 2 / np.sqrt(k))
    p = hist.sum() * risk / k
    return u + float(scale * (p**-shape - 1) / shape if abs(shape) > 1e-6 else -scale * np.log(p))


def peaks_of(hist: np.ndarray, risk: float = RISK) -> np.ndarray:
    """hist without what can't be of its tail, even were that exponential."""
    u, m = _median_excess(hist)
    return settled(hist, u + m / np.log(2) * np.log(PEAKS / risk), lambda h: pareto_level(h, 0.0, risk))


def mean_stay(stays: np.ndarray, unit_mean: float = 1.0, prior: float = 0.0) -> tuple[int, float, float]:
    """Threshold, number of stays beyond it, and their mean excess weighed with that of the unit."""
    u, w = _peaks(stays)
    k = w.sum()
    mean = (((np.arange(len(w)) + 1) * w).sum() + prior * unit_mean) / (k + prior) if k + prior else 1.0
    return u, float(k), max(float(mean), 1.02)


def stay_level(stays: np.ndarray, unit_mean: float = 1.0, prior: float = 0.0, false: float = FALSE_STAYS) -> float:
    """The length that `false` of all the stays would reach, by a geometric tail."""
    u, k, mean = mean_stay(stays, unit_mean, prior)
    return u + float(np.log(max(k, 1.0) / false) / -np.log(1 - 1 / mean))


def stays_of(stays: np.ndarray, unit_mean: float = 1.0, prior: float = 0.0, false: float = FALSE_STAYS) -> np.ndarray:
    """stays without those that can't be of their tail; first without those three times as long as nearly all."""
    return settled(stays, 3.0 * (_peaks(stays)[0] + 2), lambda s: stay_level(s, unit_mean, prior, false))


def unit_tails(hist: np.ndarray, stays: np.ndarray, stations: int, risk: float = RISK) -> tuple[float, float]:
    """Shape of the residuals' tail and mean excess of the stays, of all stations of a unit together."""
    return pareto_shape(peaks_of(hist, risk)), mean_stay(stays_of(stays, false=FALSE_STAYS * stations))[2]


def cutoffs(hist: np.ndarray, stays: np.ndarray, shape: float, unit_mean: float, risk: float = RISK) -> tuple[float, int]:
    """A station's cutoff in spreads, and the length from which a stay is a fault."""
    cut = pareto_level(peaks_of(hist, risk), shape, risk) * BIN
    return cut, int(np.ceil(stay_level(stays_of(stays, unit_mean, PRIOR), unit_mean, PRIOR)))


def _split(pairs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    both = np.zeros(BINS + STAYS, dtype=np.int64)
    for p in pairs:
        both[p["bin"]] = p["n"]
    return both[:BINS], both[BINS:]


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of_unit: dict = {}
    for batch in batches:
        cuts = []
        for unit, own, pooled, stations in zip(*(batch[c].to_pylist() for c in ("unit", "own", "pooled", "stations"))):
            if unit not in of_unit:
                of_unit[unit] = unit_tails(*_split(pooled), stations)
            cuts.append(cutoffs(*_split(own), *of_unit[unit]))
        yield pa.RecordBatch.from_arrays([batch["sid"], pa.array([c for c, _ in cuts], pa.float64()), pa.array([s for _, s in cuts], pa.int32())], names=["sid", "cut", "stuck"])


def fitted(looked: DataFrame) -> DataFrame:
    """sid, cut, stuck of every station, from the histograms of its shards and of all of its unit's; these are summed in the JVM, a station's bins are at most BINS + STAYS."""
    one = looked.where("bins is not null").select("sid", "unit", F.explode(F.arrays_zip("bins", "counts")).alias("b"))
    tails = written(one.groupBy("sid", "unit", F.col("b.bins").alias("bin")).agg(F.sum("b.counts").alias("n")), "tails")
    pair = F.collect_list(F.struct("bin", "n"))
    pooled = tails.groupBy("unit", "bin").agg(F.sum("n").alias("n"), F.count("*").alias("s")).groupBy("unit").agg(pair.alias("pooled"), F.max("s").alias("stations"))
    own = tails.groupBy("sid", "unit").agg(pair.alias("own"))
    pooled = dimension(pooled.withColumnRenamed("unit", "_u"))
    rows = own.join(pooled, F.col("unit").eqNullSafe(F.col("_u"))).select("sid", "unit", "own", "pooled", "stations")
    return written(rows.mapInArrow(_fit, "sid int, cut double, stuck int"), "cuts")


def seasonal(rows: DataFrame) -> DataFrame:
    """Per station the 24 hourly medians of its possible values, gaps bridged by its overall mean of them."""
    hour = F.floor(F.pmod(F.col("t_us"), F.lit(86_400_000_000)) / 3_600_000_000).cast("int")
    by_hour = rows.groupBy("sid", hour.alias("hour")).agg(F.percentile_approx("value", 0.5, 10_000).alias("m"))
    p = by_hour.groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("hour", "m"))).alias("by"), F.avg("m").alias("m"))
    return p.select("sid", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("by", h), "m")).alias("profile"))


def verdicts(samples: DataFrame, stations: DataFrame, pipelines: DataFrame) -> DataFrame:
    """sample_id, kind (impossible, stuck, spike), z, stay of every faulty row."""
    units = dimension(pipelines.select("pipeline", "unit").dropDuplicates(["pipeline"]))
    rows = usable(samples, stations).select("sid", "pipeline", F.greatest("interval_s", F.lit(1)).alias("interval_s"), "t_us", "sample_id", "value")
    rows = rows.join(units, "pipeline", "left")
    can = F.lit(True)
    for unit, (low, high) in POSSIBLE.items():
        can = F.when(F.col("unit") == unit, F.col("value").between(low, high)).otherwise(can)
    profile = dimension(written(seasonal(rows.where(can & ~F.col("unit").isin(*SHOWERY))), "season"))
    at = F.pmod(F.col("t_us"), F.lit(86_400_000_000)) / 3_600_000_000 - 0.5
    i = F.floor(at).cast("int")
    pick = lambda k: F.get("profile", F.pmod(k, F.lit(24)))
    season = F.round(pick(i) + (at - i) * (pick(i + 1) - pick(i)), 2)
    rows = rows.join(profile, "sid", "left").withColumn("season", F.coalesce(season, F.lit(0.0)))
    width = F.col("interval_s").cast("bigint") * (SHARD_READINGS * 1_000_000)
    halo = F.col("interval_s").cast("bigint") * (HALO_READINGS * 1_000_000)
    sharded = with_halo(rows.select("sid", "unit", "t_us", "sample_id", "value", "season", width.alias("w"), halo.alias("h")), F.col("w"), F.col("h")).drop("w", "h")
    looked = written(sharded.groupBy("sid", "shard").applyInArrow(_pass, OUT), "deviations")
    cuts = dimension(fitted(looked))
    kind = F.when(F.col("bad"), "impossible").when(F.col("stay") >= F.col("stuck"), "stuck").when(F.col("z") >= F.col("cut"), "spike")
    return looked.where("sample_id is not null").join(cuts, "sid").select("sample_id", kind.alias("kind"), "z", "stay").where("kind is not null")


def p2_found(samples: DataFrame, stations: DataFrame, pipelines: DataFrame) -> DataFrame:
    return verdicts(samples, stations, pipelines).select("sample_id")
