"""Landed JSON-line segments as DataFrames: which files are segments, and which of their lines are records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_STEM = r"^(-?\d+)(?:\.\d+)?\.jsonl$"


def segment_start(file_name: Column) -> Column:
    """Window start (seconds) in a segment's file name, null for other names."""
    return F.regexp_extract(file_name, _STEM, 1).try_cast("bigint")


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """window_start, file, line of every line of every segment in `folder`."""
    lines = spark.read.format("text").option("pathGlobFilter", "*.jsonl").load(folder)
    start = segment_start(F.col("_metadata.file_name"))
    return lines.select(start.alias("window_start"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).where("window_start is not null")


def parsed(lines: DataFrame, schema: StructType, line: str = "line", required: list[str] | None = None) -> DataFrame:
    """Adds `ok` and the fields of `schema` to lines: a record must be whole JSON and have every required field (all by default).

    Blank lines are left out; torn and other bad lines stay with ok = false, for quarantine. Fields that the schema
    doesn't have are ignored.
    """
    full = StructType([*schema.fields]).add("_bad", "string")
    got = lines.where(F.length(F.trim(F.col(line))) > 0).withColumn("_r", F.from_json(line, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    need = [f.name for f in schema.fields] if required is None else required
    ok = F.col("_r._bad").isNull()
    for name in need:
        ok = ok & F.col(f"_r.`{name}`").isNotNull()
    return got.select(*lines.columns, ok.alias("ok"), *[F.col(f"_r.`{f.name}`").alias(f.name) for f in schema.fields])


def closed(segments: DataFrame, active_window: int | Column) -> DataFrame:
    """Segments that nothing is appended to any more; the active window is one for all, or a column."""
    return segments.where(F.col("window_start") != active_window)
