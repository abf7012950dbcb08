"""Consecutive-tick dedupe: a key that the previous successful tick also had is suppressed; so are repeats within a tick.

A key that is always there passes once; one that is absent for a successful tick passes again. Ticks are numbered by
the ledger of polls: failed ones take no number, successful empty ones do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_in_batch(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The row of least `position` per key, by partial aggregation (no sort of whole groups). Null keys are a key."""
    row = F.min_by(F.struct(*rows.columns), position).alias("_r")
    return rows.groupBy(*keys).agg(row).select("_r.*")


def consecutive(rows: DataFrame, keys: Sequence[str] | None, tick: str = "tick", position: str = "pos") -> DataFrame:
    """rows of numbered ticks without what the tick before had; keys None means no dedupe at all."""
    if keys is None:
        return rows
    once = first_in_batch(rows, [tick, *keys], position)
    before = F.lag(tick).over(Window.partitionBy(*keys).orderBy(tick))
    return once.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < F.col(tick) - 1)).drop("_before")


def numbered(ledger: DataFrame, tick: str = "tick", ok: str = "ok", by: Sequence[str] = ()) -> DataFrame:
    """The successful ticks of a ledger (one row per poll) with tick_seq = 1, 2, ... in order."""
    order = Window.partitionBy(*by).orderBy(tick)
    return ledger.where(ok).select(*by, tick, F.row_number().over(order).cast("bigint").alias("tick_seq"))


def hour_of(ts: Column) -> Column:
    """Hours since 1970 of a timestamp without zone."""
    return F.floor(epoch_s(ts) / 3600)


def epoch_s(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
