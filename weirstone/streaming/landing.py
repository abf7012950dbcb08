"""The landing zone: polled answers become durable before anything else happens, and a stream reads them from there.

A source that only knows its latest answer can't be read again, so each successful poll is one file
`{window start}/{tick}.jsonl`, written aside, fsynced and renamed, and one line in the ledger. Failed polls take no tick
number; empty answers do, with an empty file. One poller per pipeline lands ticks in order.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirstone.model import FlushPolicy, checked_name
from weirstone.sources.spool import parsed


class Landing:
    def __init__(self, root: str, pipeline: str, policy: FlushPolicy | None = None) -> None:
        self.folder = os.path.join(root, checked_name(pipeline, "pipeline"))
        self.pipeline, self.policy = pipeline, policy or FlushPolicy.hourly()
        os.makedirs(os.path.join(self.folder, "ticks"), exist_ok=True)
        self.ledger = os.path.join(self.folder, "ledger.jsonl")
        self.next_tick = self._last_tick() + 1

    def _last_tick(self) -> int:
        ticks = [int(name.split(".")[0]) for _, _, names in os.walk(os.path.join(self.folder, "ticks")) for name in names if name.endswith(".jsonl")]
        return max(ticks, default=0)

    def any(self) -> bool:
        """Whether any tick has landed."""
        return self._last_tick() > 0

    def land(self, rows: list[dict], now: float) -> int:
        """Makes a successful poll durable; its tick number."""
        tick = self.next_tick
        folder = os.path.join(self.folder, "ticks", str(self.policy.align(int(now))))
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{tick:012d}.jsonl")
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            for pos, row in enumerate(rows):
                f.write(json.dumps({"tick": tick, "pos": pos, "row": json.dumps(row, ensure_ascii=False)}) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.rename(path + ".tmp", path)
        for d in (folder, os.path.join(self.folder, "ticks")):
            fd = os.open(d, os.O_RDONLY)
            os.fsync(fd)
            os.close(fd)
        self._note({"tick": tick, "at": now, "ok": True, "n_fetched": len(rows)})
        self.next_tick = tick + 1
        return tick

    def failed(self, error: Exception, now: float) -> None:
        self._note({"tick": None, "at": now, "ok": False, "error": type(error).__name__})

    def _note(self, line: dict) -> None:
        with open(self.ledger, "a", encoding="utf-8") as f:
            f.write(json.dumps(line) + "\n")

    def stream(self, spark: SparkSession, schema: StructType, max_files: int = 1000) -> DataFrame:
        """tick, pos and the fields of schema, of the rows that hold all of them."""
        lines = spark.readStream.schema("tick bigint, pos bigint, row string").option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.jsonl").json(os.path.join(self.folder, "ticks", "*"))
        return parsed(lines.where("row is not null"), schema, "row").where("ok").drop("row", "ok")


def hourly_writer(path: str, pipeline: str, ts: str):
    """A foreachBatch function that lands micro-batches under pipeline=/date=/hour=/batch=, so that a batch that runs again replaces its own files only."""

    def write(df: DataFrame, batch_id: int) -> None:
        out = df.withColumn("pipeline", F.lit(pipeline)).withColumn("date", F.date_format(ts, "yyyy-MM-dd")).withColumn("hour", F.date_format(ts, "HH")).withColumn("batch", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pipeline", "date", "hour", "batch").parquet(path)

    return write
