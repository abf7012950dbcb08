"""Sinks for polled batches, and the layers that compose them: buffer, write-ahead spool, fan-out.

A batch is what one poll of a source gives, a list of rows (dicts); it is small by nature and lives on the driver until
a terminal sink makes it a DataFrame. What is large, the landed history, is only ever touched as DataFrames.
"""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirstone.model import DownstreamError, FlushPolicy, SpoolIoError, SpoolSerializeError, TeeError, WindowMeta, checked_name

log = logging.getLogger("weirstone")
Clock = Callable[[], float]


class Sink(Protocol):
    def ingest(self, meta: WindowMeta, rows: list) -> None: ...

    def flush(self) -> None: ...


class Layered:
    """Composition for any sink: `.buffered(policy)`, `.spooled(folder, policy)`, `.tee(other)`."""

    def buffered(self, policy: FlushPolicy, clock: Clock = time.time) -> Buffered:
        return Buffered(policy, self, clock)

    def spooled(self, folder: str, policy: FlushPolicy, clock: Clock = time.time, pipeline: str | None = None) -> DiskSpool:
        return DiskSpool(folder, policy, self, clock, pipeline)

    def tee(self, other: Sink) -> Tee:
        return Tee(self, other)


class MemorySink(Layered):
    """Keeps accepted batches; fails while `failing` is set."""

    def __init__(self) -> None:
        self.batches: list[tuple[WindowMeta, list]] = []
        self.failing = self.flushed = False

    def ingest(self, meta: WindowMeta, rows: list) -> None:
        if self.failing:
            raise RuntimeError("sink is failing")
        self.batches.append((meta, list(rows)))

    def flush(self) -> None:
        self.flushed = True

    def records(self) -> list:
        return [r for _, rows in self.batches for r in rows]


class ParquetSink(Layered):
    """Lands batches under `path` in pipeline=/date=/hour= folders.

    Each batch adds files of its own name, so windows that share an hour don't replace each other; the schema is
    given, never inferred. An empty batch writes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def ingest(self, meta: WindowMeta, rows: list) -> None:
        if not rows:
            return
        df = self.spark.createDataFrame(rows, self.schema)
        at = {"pipeline": checked_name(meta.pipeline, "pipeline"), "date": f"{meta.start:%Y-%m-%d}", "hour": f"{meta.start:%H}"}
        for name, value in at.items():
            df = df.withColumn(name, F.lit(value))
        df.write.mode("append").partitionBy("pipeline", "date", "hour").parquet(self.path)

    def land(self, df: DataFrame, pipeline: str, ts: str) -> None:
        """The same for rows that are a DataFrame already: each goes to the hour of its timestamp `ts` (without zone)."""
        at = df.select(*self.schema.names, F.lit(checked_name(pipeline, "pipeline")).alias("pipeline"), F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "HH").alias("hour"))
        at.repartition("date").write.mode("append").partitionBy("pipeline", "date", "hour").parquet(self.path)

    def flush(self) -> None:
        pass


def landed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ParquetSink landed, with pipeline, date and hour as text."""
    return spark.read.schema(StructType([*schema.fields]).add("pipeline", "string").add("date", "string").add("hour", "string")).parquet(path)


class Buffered(Layered):
    """Holds batches in memory until the policy fires, which is tested after each whole batch; keeps them if the sink below fails."""

    def __init__(self, policy: FlushPolicy, inner: Sink, clock: Clock = time.time) -> None:
        self.policy, self.inner, self.clock = policy, inner, clock
        self._rows: list = []
        self._first: WindowMeta | None = None
        self._opened = 0.0

    def ingest(self, meta: WindowMeta, rows: list) -> None:
        if not rows:
            return
        if self._first is None:
            self._first, self._opened = meta, self.clock()
        self._rows += rows
        full = self.policy.max_records is not None and len(self._rows) >= self.policy.max_records
        if full or self.clock() - self._opened >= self.policy.every_s:
            self._drain()

    def _drain(self) -> None:
        if self._first is None:
            return
        end = WindowMeta.at(self._first.pipeline, 0, self.clock()).end
        self.inner.ingest(WindowMeta(self._first.pipeline, self._first.start, end), self._rows)
        self._rows, self._first = [], None

    def flush(self) -> None:
        """Drains this layer and flushes the one below, each attempted whatever happens to the other."""
        failed = None
        try:
            self._drain()
        except Exception as e:  # noqa: BLE001
            failed = e
        self.inner.flush()
        if failed:
            raise failed


class DiskSpool(Layered):
    """Write-ahead tier: a batch is on disk before `ingest` returns; closed windows go downstream, oldest first.

    One file per batch, `{window start}.{sequence}.jsonl`, written aside, fsynced and renamed, so a torn write never
    touches accepted rows. A failure downstream is logged and retried with the next batch: the accepted batch counts as
    accepted. Files that can't be decoded and lines that can't be parsed go to `quarantine/`, not away.
    """

    def __init__(self, folder: str, policy: FlushPolicy, inner: Sink, clock: Clock = time.time, pipeline: str | None = None) -> None:
        self.folder, self.policy, self.inner, self.clock = folder, policy, inner, clock
        self.pipeline = checked_name(pipeline or os.path.basename(os.path.normpath(folder)) or "unknown", "pipeline")
        self._ready, self._sequence, self._count, self._active = False, 0, 0, None
        self.last_error: Exception | None = None

    def segments(self) -> list[tuple[int, str]]:
        """(window start, file), oldest first; other names are left alone."""
        out = []
        for name in os.listdir(self.folder):
            parts = name.split(".")
            if parts[-1] != "jsonl":
                continue
            try:
                out.append((int(parts[0]), name))
            except ValueError:
                log.warning("%s: not a segment: %s", self.pipeline, name)
        return sorted(out)

    def _start(self) -> None:
        if self._ready:
            return
        os.makedirs(self.folder, exist_ok=True)
        self._ready = True
        self._sequence = max([0, *(int(n.split(".")[1]) + 1 for _, n in self.segments() if n.count(".") > 1 and n.split(".")[1].isdigit())])
        self._try_drain(True)

    def ingest(self, meta: WindowMeta, rows: list) -> None:
        self._start()
        if not rows:
            return
        window = self.policy.align(int(self.clock()))
        self._append(window, rows)
        self._count = self._count + len(rows) if window == self._active else len(rows)
        self._active = window
        full = self.policy.max_records is not None and self._count >= self.policy.max_records
        if full or any(w != window for w, _ in self.segments()):
            self._try_drain(full)

    def _append(self, window: int, rows: list) -> None:
        try:
            text = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
        except (TypeError, ValueError) as e:
            raise SpoolSerializeError(str(e)) from e
        path = os.path.join(self.folder, f"{window}.{self._sequence:09d}.jsonl")
        try:
            with open(path + ".tmp", "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.rename(path + ".tmp", path)
            fd = os.open(self.folder, os.O_RDONLY)
            os.fsync(fd)
            os.close(fd)
        except OSError as e:
            raise SpoolIoError(path, e) from e
        self._sequence += 1

    def _try_drain(self, all_: bool) -> None:
        try:
            self._drain(all_)
            self.last_error = None
        except DownstreamError as e:
            self.last_error = e
            log.warning("%s: kept in the spool: %s", self.pipeline, e)

    def _drain(self, all_: bool) -> None:
        failed: Exception | None = None
        by_window: dict[int, list[str]] = {}
        for window, name in self.segments():
            if all_ or window != self._active:
                by_window.setdefault(window, []).append(name)
        for window, names in by_window.items():
            rows = [r for n in names for r in self._read(n)]
            try:
                if rows:
                    self.inner.ingest(WindowMeta.at(self.pipeline, window, window + self.policy.window_secs()), rows)
            except Exception as e:  # noqa: BLE001
                failed = failed or e
                continue
            for n in names:
                os.remove(os.path.join(self.folder, n))
            if window == self._active:
                self._count = 0
        if failed:
            raise DownstreamError(str(failed)) from failed

    def _read(self, name: str) -> list:
        rows, bad = [], []
        with open(os.path.join(self.folder, name), "rb") as f:
            for line in f.read().split(b"\n"):
                if not line.strip():
                    continue
                try:
                    rows.append(json.loads(line.decode("utf-8")))
                except ValueError:
                    bad.append(line)
        if bad:
            log.warning("%s: %d bad lines of %s go to quarantine", self.pipeline, len(bad), name)
            os.makedirs(os.path.join(self.folder, "quarantine"), exist_ok=True)
            with open(os.path.join(self.folder, "quarantine", name), "ab") as f:
                f.write(b"\n".join(bad) + b"\n")
        return rows

    def flush(self) -> None:
        self._start()
        failed = None
        try:
            self._drain(True)
        except DownstreamError as e:
            failed = e
        self.inner.flush()
        if failed:
            raise failed


class Tee(Layered):
    """Every batch to both sinks, first then second; both are always tried."""

    def __init__(self, first: Sink, second: Sink) -> None:
        self.first, self.second = first, second

    def _both(self, act: Callable[[Sink], None]) -> None:
        errors: list[Exception | None] = []
        for sink in (self.first, self.second):
            try:
                act(sink)
                errors.append(None)
            except Exception as e:  # noqa: BLE001
                errors.append(e)
        if any(errors):
            raise TeeError(*errors)

    def ingest(self, meta: WindowMeta, rows: list) -> None:
        self._both(lambda s: s.ingest(meta, rows))

    def flush(self) -> None:
        self._both(lambda s: s.flush())


def tee_batch(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each micro-batch to all writers, computed once, and raises TeeError after trying all."""

    def run(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            errors = []
            for write in writers:
                try:
                    write(df, batch_id)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    errors.append(e)
            if any(errors):
                raise TeeError(errors[0], next((e for e in errors[1:] if e), None))
        finally:
            df.unpersist()

    return run
