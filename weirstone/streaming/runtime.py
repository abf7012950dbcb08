"""Pipelines that poll on an interval, and the supervisor that keeps them running."""

from __future__ import annotations

import logging
import signal
import threading
import time
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field

from weirstone.model import SignalSetupError, WindowMeta
from weirstone.sinks import Sink
from weirstone.sources.collector import Collector

log = logging.getLogger("weirstone")


class ConsecutiveKeys:
    """The keys of the last successful tick; what a new tick shares with it, or repeats, is left out. key None keeps all."""

    def __init__(self, key: Callable[[dict], Hashable] | None) -> None:
        self.key, self.last = key, set()

    def fresh(self, rows: list) -> list:
        if self.key is None:
            return rows
        seen, out = set(), []
        for row in rows:
            k = self.key(row)
            if k not in seen and k not in self.last:
                out.append(row)
            seen.add(k)
        self.last = seen
        return out


def ticks(stop: threading.Event, interval_s: float, clock: Callable[[], float], wait: Callable[[threading.Event, float], bool] | None = None) -> Iterator[int]:
    """1, 2, ... at once and on every interval until `stop`. Ticks don't drift by the time they take; those missed by a tick that took too long are left out."""
    due, n = clock(), 0
    while not stop.is_set():
        n += 1
        yield n
        due += interval_s
        late = clock() - due
        if late > 0 and interval_s > 0:
            due += -(-late // interval_s) * interval_s
        pause = max(0.0, due - clock())
        if wait(stop, pause) if wait else stop.wait(pause):
            return


@dataclass
class Pipeline:
    """Polls a collector into a sink until told to stop; errors of either don't end it."""

    collector: Collector
    sink: Sink
    interval_s: float
    key: Callable[[dict], Hashable] | None = None
    clock: Callable[[], float] = time.time
    wait: Callable[[threading.Event, float], bool] | None = None
    errors: list[str] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.collector.name

    def _flush(self, when: str) -> None:
        try:
            self.sink.flush()
        except Exception as e:  # noqa: BLE001
            self.errors.append(f"{when}: {e}")
            log.warning("%s: %s flush failed: %s", self.name, when, e)

    def tick(self, keys: ConsecutiveKeys) -> None:
        start = self.clock()
        try:
            rows = self.collector.collect()
        except Exception as e:  # noqa: BLE001
            log.warning("%s: collect failed: %s", self.name, e)
            return
        fresh = keys.fresh(rows)
        log.info("%s: %d fetched, %d fresh", self.name, len(rows), len(fresh))
        if not fresh:
            return
        try:
            self.sink.ingest(WindowMeta.at(self.name, start, self.clock()), fresh)
        except Exception as e:  # noqa: BLE001
            self.errors.append(f"ingest: {e}")
            log.warning("%s: ingest failed: %s", self.name, e)

    def run(self, stop: threading.Event) -> None:
        """Replays what a former run left, then ticks at once and on the interval, then drains."""
        self._flush("startup")
        keys = ConsecutiveKeys(self.key)
        for _ in ticks(stop, self.interval_s, self.clock, self.wait):
            self.tick(keys)
        self._flush("final")


@dataclass
class Outcome:
    builds: int = 0
    failures: int = 0
    gave_up: bool = False
    errors: list[str] = field(default_factory=list)


@dataclass
class Supervisor:
    """One thread per pipeline factory. A pipeline that breaks is built anew after a delay that doubles; after more than
    `max_failures` breaks in a row, each within `streak_s` of its start, it is given up. One that ends is not restarted."""

    max_failures: int = 5
    base_backoff_s: float = 1.0
    streak_s: float = 300.0
    clock: Callable[[], float] = time.monotonic
    factories: list[Callable[[], Pipeline]] = field(default_factory=list)

    def pipeline(self, factory: Callable[[], Pipeline]) -> Supervisor:
        self.factories.append(factory)
        return self

    def backoff(self, failures: int) -> float:
        return self.base_backoff_s * 2 ** min(failures - 1, 16)

    def _keep(self, factory: Callable[[], Pipeline], stop: threading.Event, out: Outcome) -> None:
        while not stop.is_set():
            began = self.clock()
            try:
                out.builds += 1
                p = factory()
                p.run(stop)
                out.errors += p.errors
                return
            except Exception as e:  # noqa: BLE001
                out.errors.append(str(e))
                if self.clock() - began >= self.streak_s:
                    out.failures = 0
                out.failures += 1
                if out.failures > self.max_failures:
                    out.gave_up = True
                    log.error("given up after %d failures: %s", out.failures, e)
                    return
                stop.wait(self.backoff(out.failures))

    def run(self, stop: threading.Event | None = None, signals: bool = False) -> list[Outcome]:
        """Runs all until `stop` is set (also by SIGTERM or SIGINT, with signals) or all have ended; a report for each."""
        stop = stop or threading.Event()
        if signals:
            try:
                for s in (signal.SIGTERM, signal.SIGINT):
                    signal.signal(s, lambda *_: stop.set())
            except (ValueError, OSError) as e:
                raise SignalSetupError(str(e)) from e
        outs = [Outcome() for _ in self.factories]
        threads = [threading.Thread(target=self._keep, args=(f, stop, o), daemon=True) for f, o in zip(self.factories, outs)]
        for t in threads:
            t.start()
        for t in threads:
            while t.is_alive():
                t.join(0.2)
        return outs
