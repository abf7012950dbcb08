"""Flush decisions replayed over batches: which output a batch ends up in.

Both are folds in order of arrival. Input is one row per batch (tick and row count), never rows; partitions are sorted
and streamed through Python with constant state, so nothing of a group is gathered. Windows of the spool, and pipelines
of the buffer, fold independently.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def _folded(batches: DataFrame, keys: Sequence[str], order: str, max_records: int | None, every: int | None) -> DataFrame:
    columns = [*keys, order, "n"]
    rows = batches.select(*columns)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, segment, held, opened = object(), 0, 0, None
        for part in parts:
            segments, last = [], []
            cols = [part[c].to_pylist() for c in columns]
            for *k, at, n in zip(*cols):
                if k != key:
                    key, segment, held, opened = k, 0, 0, None
                if opened is None:
                    opened = at
                held += n
                segments.append(segment)
                full = (max_records is not None and held >= max_records) or (every is not None and at - opened >= every)
                last.append(full)
                if full:
                    segment, held, opened = segment + 1, 0, None
            yield pa.RecordBatch.from_arrays([*[part[c] for c in columns], pa.array(segments, pa.int64()), pa.array(last, pa.bool_())], names=[*columns, "segment", "fires"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, f"{kinds}, segment bigint, fires boolean")


def buffered(batches: DataFrame, every: int, max_records: int | None, order: str = "tick", by: Sequence[str] = ("pipeline",)) -> DataFrame:
    """batches: by, order, n. The buffer opens with its first batch and fires after a whole batch, at max_records or `every` units of order."""
    return _folded(batches, by, order, max_records, every)


def spooled(batches: DataFrame, max_records: int | None, order: str = "tick", by: Sequence[str] = ("pipeline", "window_start")) -> DataFrame:
    """batches: by (with the window), order, n. A window drains whenever it holds max_records, and at its end."""
    return _folded(batches, by, order, max_records, None)
