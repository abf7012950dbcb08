"""Consecutive-tick dedupe over a stream, with the last ticks of the keys in the state store.

Keys share a state by hash, so that a micro-batch costs one Python call a bucket and not one a key. State survives
restarts. A key can only suppress the tick right after its last one, so its bucket's state drops it some ticks later: by
the numbers of ticks, not by the clock. Without a timeout no empty micro-batch follows each one with rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, FloatType, LongType

#: States that the keys of a stream are spread over. A checkpoint holds for one number only.
_BUCKETS = 256
#: Ticks by which a row may lie behind what its bucket had before; those further behind are left out.
_LATE = 2
_LAST = (1 << 63) - 1
_JSON = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _key(rows: DataFrame, keys: Sequence[str]) -> Column:
    """One text a key, another for each, nulls and -0.0 as in a group by."""
    zero = lambda k: F.col(k) + F.lit(0.0).cast(rows.schema[k].dataType)
    return F.to_json(F.struct(*[zero(k).alias(k) if isinstance(rows.schema[k].dataType, DoubleType | FloatType) else F.col(k) for k in keys]), _JSON)


def consecutive_stream(rows: DataFrame, keys: Sequence[str], tick: str = "tick", position: str = "pos") -> DataFrame:
    """rows: a stream with numbered ticks, delivered in order of tick. Gives what `consecutive` gives in batch."""
    longs = [f.name for f in rows.schema if isinstance(f.dataType, LongType) and f.name != tick]  # go as text: pandas makes floats of them beside nulls
    sent = [F.col(c).cast("string").alias(c) if c in longs else F.col(c) for c in rows.columns]
    schema = rows.select(*sent).schema

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = json.loads(state.get[0]) if state.exists else {}
        pdf = pd.concat(list(parts), ignore_index=True).astype({tick: "int64"})
        if last:
            pdf = pdf[pdf[tick] >= max(last.values()) - _LATE]
        pdf = pdf.sort_values([tick, "_position"], kind="stable").drop_duplicates(["_key", tick])
        before = pdf.groupby("_key", sort=False)[tick].shift().fillna(pdf["_key"].map(last).astype("float64"))
        last.update(zip(pdf["_key"].tolist(), pdf[tick].tolist(), strict=True))  # in order of tick
        oldest = max(last.values()) - _LATE - 1
        state.update((json.dumps({k: t for k, t in last.items() if t >= oldest}),))
        out = pdf[before.isna() | (before < pdf[tick] - 1)]
        if len(out):
            yield out[schema.names]

    key = _key(rows, keys)
    order = F.coalesce(position, F.lit(_LAST)) if position in longs else F.col(position)
    keyed = rows.select(*sent, order.alias("_position"), key.alias("_key"), F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).alias("_bucket"))
    kept = keyed.groupBy("_bucket").applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)
    return kept.select(*[F.col(c).cast("bigint").alias(c) if c in longs else F.col(c) for c in rows.columns])
