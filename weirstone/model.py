"""Windows, flush policies, names and errors shared by sources, sinks and runtime."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime

_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def checked_name(name: str, what: str = "name") -> str:
    """A name that is safe as a path segment."""
    if not _NAME.fullmatch(name or "") or name in (".", ".."):
        raise ValueError(f"{what} {name!r} is not a plain path segment")
    return name


@dataclass(frozen=True)
class WindowMeta:
    """What a batch says about itself: its pipeline and the span of time it covers, in UTC."""

    pipeline: str
    start: datetime
    end: datetime

    @staticmethod
    def at(pipeline: str, start: float, end: float) -> WindowMeta:
        return WindowMeta(pipeline, datetime.fromtimestamp(start, UTC), datetime.fromtimestamp(end, UTC))


@dataclass(frozen=True)
class FlushPolicy:
    """When a layer hands on what it holds: after `every_s` seconds, or at `max_records` records if that is set."""

    every_s: float
    max_records: int | None = None

    @staticmethod
    def every(seconds: float) -> FlushPolicy:
        return FlushPolicy(seconds)

    @staticmethod
    def hourly() -> FlushPolicy:
        return FlushPolicy(3600)

    def window_secs(self) -> int:
        """Whole seconds of a window, at least one."""
        return max(1, int(self.every_s))

    def align(self, unix_s: int) -> int:
        """Start of the window that holds the instant; right before 1970 too."""
        return unix_s - unix_s % self.window_secs()


def object_path(meta: WindowMeta) -> str:
    """Hour path of a window; use it for interchange only, several windows of an hour share it."""
    return f"data/{checked_name(meta.pipeline, 'pipeline')}/{meta.start:%Y-%m-%d}/{meta.start:%H}.parquet"


class SpoolError(Exception):
    """The spool could not keep or read a segment."""


class SpoolIoError(SpoolError):
    def __init__(self, path: str, cause: Exception) -> None:
        super().__init__(f"{path}: {cause}")
        self.path = path


class SpoolSerializeError(SpoolError):
    pass


class DownstreamError(SpoolError):
    """The sink below failed; what it was given is still in the spool."""


class TeeError(Exception):
    """Which branches of a fan-out failed."""

    def __init__(self, first: Exception | None, second: Exception | None) -> None:
        super().__init__(f"first: {first}, second: {second}")
        self.first, self.second = first, second


class RejectedError(Exception):
    """The remote side answered with a status other than success."""

    def __init__(self, status: int, body: str) -> None:
        super().__init__(f"status {status}: {body}")
        self.status, self.body = status, body


class EncodeError(Exception):
    """Rows that the schema can't hold."""


class TransportError(Exception):
    """A request that got no answer."""


class SignalSetupError(Exception):
    """The signals that stop a supervisor can't be caught here."""
