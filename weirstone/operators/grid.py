"""Problem 1: irregular readings onto a regular grid.

Slots of a station are [k*interval_s, (k+1)*interval_s) since 1970 UTC. Readings are averaged by slot; between a
station's first and last slot every empty slot is `filled` by shape-preserving monotone cubic interpolation
(harmonic-mean tangents) between the mean instants of its neighbours, or, where the gap is longer than `max_fill`
slots, marked `gap` with a null value. A gap that long also ends the segment over which tangents are taken.

A station is cut into time shards of `shard_slots` slots, so no task holds a whole station. Tangents need one more
reading beyond either end of a gap; the two first and two last slots of each shard are the halo that neighbours
exchange, all the rest is computed inside the shard after one shuffle. The slots of a gap are made piece by piece.

Defined results: null or NaN values and unreadable timestamps are no readings; repeated rows weigh as often as they
come; a station with one slot gives that slot; tied instants of one slot are averaged; interval_s null or not
positive: the station has no grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.readings import named, usable
from weirstone.shared import written

SHARD_SLOTS = 2048
MAX_FILL = 12


def _inner(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Tangent between two secants: weighted harmonic mean, 0 at a local extremum."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 > 0, (w0 + w1) / (w0 / d0 + w1 / d1)).otherwise(0.0)


def _end(h1: Column, d1: Column, h2: Column, d2: Column) -> Column:
    """One-sided tangent at an end of a segment, limited so that the curve keeps the data's shape."""
    m = ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2)
    return F.when(F.signum(m) != F.signum(d1), 0.0).when((F.signum(d1) != F.signum(d2)) & (F.abs(m) > 3 * F.abs(d1)), 3 * d1).otherwise(m)


def _slots(readings: DataFrame, shard_slots: int) -> DataFrame:
    t = F.col("t_us") / 1e6 / F.col("interval_s")
    rows = readings.where("interval_s > 0").select("sid", "interval_s", F.floor(F.col("t_us") / (F.col("interval_s").cast("long") * 1_000_000)).alias("slot"), t.alias("x"), "value")
    rows = rows.withColumn("shard", F.floor(F.col("slot") / shard_slots)).repartition("sid", "shard")
    return rows.groupBy("sid", "shard", "slot", "interval_s").agg(F.avg("x").alias("x"), F.avg("value").alias("v"), F.count("*").alias("n"))


def regular_grid(readings: DataFrame, max_fill: int = MAX_FILL, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """readings: sid, interval_s, t_us, value. Gives sid, slot_start (seconds), status, value, n_readings."""
    point = F.struct("slot", "x", "v")
    w = Window.partitionBy("sid", "shard").orderBy("slot")
    shards = _slots(readings, shard_slots).select(
        "sid", "interval_s", "slot", "x", "v", "n",
        F.lag(point).over(w).alias("p"), F.lead(point).over(w).alias("b"), F.lead(point, 2).over(w).alias("c"), F.lag(F.lit(1), 2).over(w).alias("second"),
    )
    edge = F.col("second").isNull() | F.col("c").isNull()
    along = Window.partitionBy("sid").orderBy("slot")
    edges = shards.where(edge).select(
        "sid", "interval_s", "slot", "x", "v", "n",
        F.coalesce("p", F.lag(point).over(along)).alias("p"), F.coalesce("b", F.lead(point).over(along)).alias("b"), F.coalesce("c", F.lead(point, 2).over(along)).alias("c"),
    )
    rows = shards.where(~edge).drop("second").unionByName(edges)
    return _interpolated(rows, max_fill, shard_slots)


def _interpolated(rows: DataFrame, max_fill: int, shard_slots: int) -> DataFrame:
    a = {"slot": F.col("slot"), "x": F.col("x"), "v": F.col("v")}
    near = lambda p, q: (q["slot"] - p["slot"] - 1) <= max_fill
    P, B, C = F.col("p"), F.col("b"), F.col("c")
    h0, h1, h2 = a["x"] - P["x"], B["x"] - a["x"], C["x"] - B["x"]
    d0, d1, d2 = (a["v"] - P["v"]) / h0, (B["v"] - a["v"]) / h1, (C["v"] - B["v"]) / h2
    has_p, has_c = P.isNotNull() & near(P, a), C.isNotNull() & near(B, C)
    m0 = F.when(has_p, _inner(h0, d0, h1, d1)).when(has_c, _end(h1, d1, h2, d2)).otherwise(d1)
    m1 = F.when(has_c, _inner(h1, d1, h2, d2)).when(has_p, _end(h1, d1, h0, d0)).otherwise(d1)
    gap = B["slot"] - F.col("slot") - 1
    last = F.coalesce(B["slot"] - 1, F.col("slot"))
    piece = F.greatest(F.lit(shard_slots).cast("bigint"), F.ceil(F.sqrt(last - F.col("slot"))))  # a gap is cut before it is filled, so no array is long
    fill = (gap > 0) & (gap <= max_fill)
    out = rows.select("sid", "interval_s", "slot", "v", "n", "x", gap.alias("gap"), F.when(fill, h1).alias("h"), F.when(fill, m0).alias("m0"), F.when(fill, m1).alias("m1"), B["v"].alias("v1"), last.alias("last"), piece.alias("piece"), F.explode(F.sequence(F.col("slot"), last, piece)).alias("from"))
    out = out.select("*", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + F.col("piece") - 1, F.col("last")))).alias("k"))
    s = (F.col("k") + 0.5 - F.col("x")) / F.col("h")
    curve = (1 + 2 * s) * (1 - s) * (1 - s) * F.col("v") + s * (1 - s) * (1 - s) * F.col("h") * F.col("m0") + s * s * (3 - 2 * s) * F.col("v1") + s * s * (s - 1) * F.col("h") * F.col("m1")
    seen = F.col("k") == F.col("slot")
    return out.select(
        "sid",
        (F.col("k") * F.col("interval_s")).cast("bigint").alias("slot_start"),
        F.when(seen, "observed").when(F.col("gap") <= max_fill, "filled").otherwise("gap").alias("status"),
        F.when(seen, F.col("v")).when(F.col("gap") <= max_fill, curve).alias("value"),
        F.when(seen, F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("n_readings"),
    )


def p1_grid(samples: DataFrame, stations: DataFrame, max_fill: int = MAX_FILL) -> DataFrame:
    return named(regular_grid(usable(samples, stations), max_fill), stations)


def p1_found(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """Slots without a usable reading between a station's first and last one: the filled and the marked ones of the grid, which is kept as a table."""
    grid = written(regular_grid(usable(samples, stations)), "grid")
    return named(grid.where("status != 'observed'").select("sid", "slot_start"), stations)
