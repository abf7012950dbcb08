"""From answers to rows: flatten, unpivot, keep what is ok, look names up, fan out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.shared import dimension


def flattened(answers: DataFrame, snapshots: str, data: str) -> DataFrame:
    """One row per reading of `answers.snapshots[].data[]`: the snapshot's and the reading's fields, stations looked up elsewhere."""
    snap = answers.select(*[c for c in answers.columns if c != snapshots], F.explode(snapshots).alias("_s"))
    rest = [F.col(f"_s.`{f.name}`").alias(f.name) for f in snap.schema["_s"].dataType.fields if f.name != data]
    return snap.select(*[c for c in snap.columns if c != "_s"], *rest, F.explode(F.col(f"_s.`{data}`")).alias("_d")).select("*", "_d.*").drop("_d")


def unpivoted(wide: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per id and column of values, as doubles."""
    cast = wide.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return cast.unpivot(list(ids), list(values), name, value)


def only_ok(answers: DataFrame, ok: Column) -> DataFrame:
    """Other answers, and those of unknown state, give no rows."""
    return answers.where(ok)


def looked_up(rows: DataFrame, names: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Adds names.name by key: the one of the highest `order` where a key comes more than once, '' where it doesn't come."""
    latest = names.groupBy(key).agg(F.max_by(name, order).alias(name))
    return rows.join(dimension(latest), key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def branches(rows: DataFrame, **kept: Column) -> DataFrame:
    """The rows of all branches of a fan-out, tagged with `branch`; a row goes to every branch whose condition it meets, in one pass."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(tag)) for tag, cond in kept.items()]))
    return rows.withColumn("branch", F.explode(tags))
