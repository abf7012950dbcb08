"""Footprint statistics over samples in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.functions.scalar import duration_label, round_half_up


def valid(samples: DataFrame, *values: str) -> DataFrame:
    """Rows whose values are all numbers."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    return samples.where(ok)


def summary(samples: DataFrame, value: str, step_s: int = 2) -> DataFrame:
    """n, mean, peak (two decimals) and the label of the time that n samples take."""
    return samples.agg(F.count("*").alias("n"), round_half_up(F.avg(value), 2).alias("mean"), round_half_up(F.max(value), 2).alias("peak")).withColumn("duration", duration_label(F.col("n") * step_s))


def indexed(samples: DataFrame, *order: str, parts: int = 64) -> DataFrame:
    """Adds i = 0, 1, ... in order, without one task that sorts all: rows are range-partitioned, counted and offset."""
    ranged = samples.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # one row per partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("i", (F.col("_before") + within).cast("bigint")).drop("_part", "_before")


def downsampled(samples: DataFrame, order: list[str], value: str, points: int = 120, step_s: int = 2) -> DataFrame:
    """At most `points` rows: t of the first, peak and mean of each run of ceil(n / points) consecutive samples."""
    n = samples.count()
    size = max(1, -(-n // points))
    bucket = F.floor(F.col("i") / size)
    return indexed(samples, *order).groupBy(bucket.alias("b")).agg((F.min("i") * step_s).alias("t"), round_half_up(F.max(value), 2).alias("peak"), round_half_up(F.avg(value), 1).alias("mean")).drop("b")


def peak_point(points: DataFrame, value: str, t: str) -> DataFrame:
    """The row of the highest value, the first of equals."""
    return points.agg(F.max_by(F.struct(*points.columns), F.struct(F.col(value), -F.col(t))).alias("r")).select("r.*")


def tick_metrics(fetched: DataFrame, fresh: DataFrame, tick: str = "tick") -> DataFrame:
    """tick, fetched, fresh: how many rows each tick brought, and how many of them the dedupe let through."""
    all_ = fetched.groupBy(tick).agg(F.count("*").alias("fetched"))
    new = fresh.groupBy(tick).agg(F.count("*").alias("fresh"))
    return all_.join(new, tick, "left").select(tick, "fetched", F.coalesce("fresh", F.lit(0)).alias("fresh"))
