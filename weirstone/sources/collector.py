"""Collectors: what is polled. A function and a transform make one; a replayable one is also a Spark data source."""

from __future__ import annotations

import os
import subprocess
import time
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class Collector(Protocol):
    name: str

    def collect(self) -> list[dict]: ...


@dataclass
class FunctionCollector:
    """One request per tick, and the function that flattens its answer to rows. An answer that isn't ok gives none."""

    name: str
    fetch: Callable[[], Any]
    transform: Callable[[Any], list[dict]] = list
    ok: Callable[[Any], bool] = lambda _: True

    def collect(self) -> list[dict]:
        answer = self.fetch()
        return list(self.transform(answer)) if self.ok(answer) else []


@dataclass
class ProcessSampler:
    """Processor share and resident kilobytes of a process, each time it is asked; none once the process is gone."""

    pid: int
    name: str = "process"

    def collect(self) -> list[dict]:
        got = subprocess.run(["ps", "-o", "%cpu=,rss=", "-p", str(self.pid)], capture_output=True, text=True).stdout.split()
        if len(got) != 2:
            return []
        return [{"ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "cpu": float(got[0]), "rss": int(got[1])}]


class TickSource(DataSource):
    """`spark.readStream.format("ticks")` over a folder of numbered answers `{n}.json`, one tick each; replays any range."""

    @classmethod
    def name(cls) -> str:
        return "ticks"

    def schema(self) -> str:
        return self.options.get("schema", "tick bigint, payload string")

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _TickReader(self.options["path"])


class _TickReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _ticks(self) -> list[int]:
        return sorted(int(n[:-5]) for n in os.listdir(self.path) if n.endswith(".json") and n[:-5].isdigit())

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def _rows(self, start: int, end: int) -> Iterator[tuple]:
        for n in self._ticks():
            if start <= n < end:
                with open(os.path.join(self.path, f"{n}.json"), encoding="utf-8") as f:
                    yield n, f.read()

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = max([start["next"], *(n + 1 for n in self._ticks())])
        return iter(list(self._rows(start["next"], end))), {"next": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(list(self._rows(start["next"], end["next"])))

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Config:
    """A collection set-up read from TOML: spool folder, flush policy, repository, and an interval per collector."""

    spool_dir: str
    every_s: float
    max_records: int | None
    repo: str | None
    branch: str = "main"
    intervals: dict[str, float] = field(default_factory=dict)

    def interval(self, name: str) -> float:
        return self.intervals.get(name, 60.0)


_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}


def seconds(text: str | float) -> float:
    """Seconds of a duration such as 90, "10m" or "1h"."""
    if isinstance(text, int | float):
        return float(text)
    for unit in sorted(_UNITS, key=len, reverse=True):
        if text.endswith(unit):
            return float(text[: -len(unit)]) * _UNITS[unit]
    return float(text)


def load_config(text: str) -> Config:
    got = tomllib.loads(text)
    flush, sink = got.get("flush", {}), next(iter(got.get("sink", {}).values()), {})
    intervals = {k: seconds(v["interval"]) for k, v in got.get("collectors", {}).items() if "interval" in v}
    return Config(got["spool_dir"], seconds(flush.get("every", 3600)), flush.get("max_records"), sink.get("repo"), sink.get("branch", "main"), intervals)
