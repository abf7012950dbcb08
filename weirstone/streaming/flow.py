"""A pipeline that lands every poll before anything else, and brings what landed to Parquet as a stream.

Polls go to the landing zone; the stream reads ticks from there, leaves out what the tick before had, with the keys in the
state store, and writes hours. Whatever breaks, ticks that landed are neither lost nor written twice: the stream takes up
where its checkpoint ends. It has the shape of `Pipeline`, so a `Supervisor` keeps it running.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from weirstone.sources.collector import Collector
from weirstone.streaming.dedupe import consecutive_stream
from weirstone.streaming.landing import Landing, hourly_writer
from weirstone.streaming.runtime import ticks

log = logging.getLogger("weirstone")


@dataclass
class LandedPipeline:
    """collector -> landing -> consecutive dedupe by `keys` (None for none) -> hours of `ts` under `target`."""

    spark: SparkSession
    collector: Collector
    landing: Landing
    schema: StructType
    ts: str
    target: str
    interval_s: float
    keys: Sequence[str] | None = None
    every: int = 1
    clock: Callable[[], float] = time.time
    wait: Callable[[threading.Event, float], bool] | None = None
    max_files: int = 1000
    errors: list[str] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.collector.name

    def poll(self) -> None:
        now = self.clock()
        try:
            rows = self.collector.collect()
        except Exception as e:  # noqa: BLE001
            self.landing.failed(e, now)
            log.warning("%s: collect failed: %s", self.name, e)
            return
        self.landing.land(rows, now)

    def deliver(self) -> None:
        """Brings all that has landed since the last delivery to the target."""
        if not self.landing.any():
            return
        rows = self.landing.stream(self.spark, self.schema, self.max_files)
        if self.keys is not None:
            rows = consecutive_stream(rows, self.keys)
        query = rows.writeStream.foreachBatch(hourly_writer(self.target, self.name, self.ts)).option("checkpointLocation", f"{self.target}.checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def _deliver(self, when: str) -> None:
        try:
            self.deliver()
        except Exception as e:  # noqa: BLE001
            self.errors.append(f"{when}: {e}")
            log.warning("%s: %s delivery failed, kept in the landing zone: %s", self.name, when, e)

    def run(self, stop: threading.Event) -> None:
        """Delivers what a former run left, then polls on the interval and delivers every `every` polls, then delivers the rest."""
        self._deliver("startup")
        for n in ticks(stop, self.interval_s, self.clock, self.wait):
            self.poll()
            if n % self.every == 0:
                self._deliver("tick")
        self._deliver("final")


class ProgressLog(StreamingQueryListener):
    """One log line for each micro-batch of every query of the session: `spark.streams.addListener(ProgressLog())`."""

    def onQueryStarted(self, event) -> None:  # noqa: N802
        log.info("query %s started", event.name or event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        log.info("query %s batch %d: %d rows, state %s", p.name or p.id, p.batchId, p.numInputRows, [s.numRowsTotal for s in p.stateOperators])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        log.info("query %s ended%s", event.id, f": {event.exception}" if event.exception else "")
