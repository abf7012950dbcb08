"""Commits of one file each to a dataset repository: the request, the answer, and the sink that encodes, sends and maps."""

from __future__ import annotations

import base64
import io
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from weirstone.model import EncodeError, RejectedError, TransportError, WindowMeta, checked_name, object_path
from weirstone.sinks import Layered


@dataclass(frozen=True)
class Request:
    method: str
    url: str
    headers: dict[str, str] = field(repr=False)  # holds the token
    body: bytes = b""


@dataclass(frozen=True)
class CommitResponse:
    commit_url: str | None = None
    commit_oid: str | None = None


@dataclass(frozen=True)
class CommitAction:
    repo: str
    branch: str
    token: str = field(repr=False)
    summary: str = ""
    path_in_repo: str = ""
    content: bytes = b""

    def request(self, host: str) -> Request:
        """Two JSON lines: a header with the summary and the file in base64."""
        for part in self.repo.split("/"):
            checked_name(part, "repo")
        # fixed values of the wire format: the keys of both lines, the encoding, the headers and the address
        lines = [
            {"key": "header", "value": {"summary": self.summary}},
            {"key": "file", "value": {"path": self.path_in_repo, "content": base64.b64encode(self.content).decode(), "encoding": "base64"}},
        ]
        body = "".join(json.dumps(x, separators=(",", ":")) + "\n" for x in lines).encode()
        headers = {"authorization": f"Bearer {self.token}", "content-type": "application/x-ndjson"}
        return Request("POST", f"{host.rstrip('/')}/api/datasets/{self.repo}/commit/{checked_name(self.branch, 'branch')}", headers, body)

    @staticmethod
    def decode(status: int, body: bytes) -> CommitResponse:
        """The commit's address, or RejectedError with the body as far as it is UTF-8."""
        if not 200 <= status < 300:
            raise RejectedError(status, body.decode("utf-8", "replace"))
        got = json.loads(body or b"{}")
        return CommitResponse(got.get("commitUrl"), got.get("commitOid"))


def summary_of(meta: WindowMeta) -> str:
    return f"collect: {meta.pipeline} window {meta.start:%Y-%m-%dT%H:%M:%SZ} → {meta.end:%Y-%m-%dT%H:%M:%SZ}"


def encode(rows: list[dict], schema: pa.Schema) -> bytes:
    """Rows as one Parquet file. The schema is given, so no rows make a file of no rows; fields that it doesn't have are left out, missing ones are null."""
    try:
        table = pa.Table.from_pylist(rows, schema=schema)
        table.validate(full=True)
        for f in schema:
            if not f.nullable and table[f.name].null_count:
                raise EncodeError(f"{f.name} is null")
    except (pa.ArrowException, TypeError, AttributeError) as e:
        raise EncodeError(str(e)) from e
    out = io.BytesIO()
    pq.write_table(table, out)
    return out.getvalue()


class Client(Protocol):
    def send(self, request: Request) -> tuple[int, bytes]:
        """Status and body of the answer; OSError if there is none."""
        ...


@dataclass
class HttpClient:
    timeout_s: float = 30.0

    def send(self, request: Request) -> tuple[int, bytes]:
        req = urllib.request.Request(request.url, request.body, request.headers, method=request.method)
        try:
            with urllib.request.urlopen(req, timeout=self.timeout_s) as answer:  # noqa: S310
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()


@dataclass
class CommitSink(Layered):
    """A terminal sink: each batch is one Parquet file at its window's hour path, sent as one commit. An empty batch sends nothing.

    EncodeError, TransportError and RejectedError say which step failed; the layers above keep the batch then.
    """

    host: str
    repo: str
    branch: str
    token: str = field(repr=False)
    schema: pa.Schema = field(repr=False)
    client: Client = field(default_factory=HttpClient)
    last: CommitResponse | None = None

    def ingest(self, meta: WindowMeta, rows: list[dict]) -> None:
        if not rows:
            return
        action = CommitAction(self.repo, self.branch, self.token, summary_of(meta), object_path(meta), encode(rows, self.schema))
        try:
            status, body = self.client.send(action.request(self.host))
        except OSError as e:
            raise TransportError(f"{self.host}: {e}") from e
        self.last = CommitAction.decode(status, body)

    def flush(self) -> None:
        pass


def payloads(files: DataFrame, path: str, content: str) -> DataFrame:
    """Adds payload, the second line of the commit request of each file."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [CommitAction("r", "main", "", "", p, c).request("").body.decode().split("\n")[1] for p, c in zip(batch[path].to_pylist(), batch[content].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "payload"])

    return files.mapInArrow(run, f"{kinds}, payload string")
