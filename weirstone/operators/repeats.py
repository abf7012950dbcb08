"""Readings of one station that say the same again: an instant at most `within_us` from that of an earlier row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WITHIN_US = 3_000_000


def with_halo(rows: DataFrame, width_us: int, halo_us: int) -> DataFrame:
    """Adds shard (floor of t_us by width_us) and core; rows near a border come again, with core = false, in the neighbouring shard."""
    shard = F.floor(F.col("t_us") / width_us)
    here = lambda d: F.floor((F.col("t_us") + d) / width_us)
    shards = F.array_distinct(F.array(shard, here(-halo_us), here(halo_us)))
    return rows.withColumn("_own", shard).withColumn("shard", F.explode(shards)).withColumn("core", F.col("shard") == F.col("_own")).drop("_own")


def marked(sharded: DataFrame, within_us: int = WITHIN_US) -> DataFrame:
    """sharded: sid, shard, t_us, sample_id, laid out by (sid, shard). Adds repeat: a row of smaller sample_id lies within the distance.

    Rows of a null t_us must be left out before. Copies of a row with the same sample_id are no repeats of each other.
    """
    near = Window.partitionBy("sid", "shard").orderBy("t_us").rangeBetween(-within_us, within_us)
    return sharded.withColumn("repeat", F.min("sample_id").over(near) < F.col("sample_id"))
