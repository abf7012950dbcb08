"""Footprint of a process as one document, from its samples: how many, over what time, averages, peaks and a chart."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from weirstone.functions.scalar import duration_label, round_half_up
from weirstone.operators.stats import indexed, valid
from weirstone.sources.spool import parsed

SAMPLE = StructType([StructField("ts", StringType()), StructField("cpu", DoubleType()), StructField("rss", DoubleType())])
STEP_S = 2
POINTS = 120


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """ts, cpu, rss (kilobytes) of every whole line of a file of JSON lines that has both numbers; a missing file is an error at once, torn lines are left out."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    at = path_of(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return valid(parsed(lines, SAMPLE, required=["cpu", "rss"]).where("ok").select("ts", "cpu", "rss"), "cpu", "rss")


def footprint(samples: DataFrame, order: list[str], points: int = POINTS, step_s: int = STEP_S) -> DataFrame:
    """One row: samples, duration_label, cpu {avg, peak, unit}, rss {avg_mb, peak_mb}, chart [{t, cpu, rss}] of at most `points` runs of samples; none of no samples.

    A point has the peak of cpu and the mean of rss of its run; t counts seconds from the first sample by `step_s` each. Up to `points` samples are points as they are.
    """
    n = samples.count()
    size = max(1, -(-n // points))
    rows = indexed(samples, *order).groupBy(F.floor(F.col("i") / size).alias("b")).agg(
        (F.min("i") * step_s).alias("t"), F.max("cpu").alias("top"), F.count("*").alias("n"), F.sum("cpu").alias("cpu"), F.sum("rss").alias("rss"), F.max("rss").alias("most"),
    )
    mb = lambda x: round_half_up(x / 1024, 1)
    point = F.struct("t", (F.col("top") if size == 1 else round_half_up(F.col("top"), 2)).alias("cpu"), mb(F.col("rss") / F.col("n")).alias("rss"))
    total = F.sum("n")
    return rows.agg(
        total.alias("samples"), duration_label(total * step_s).alias("duration_label"),
        F.struct(round_half_up(F.sum("cpu") / total, 2).alias("avg"), round_half_up(F.max("top"), 2).alias("peak"), F.lit("%").alias("unit")).alias("cpu"),
        F.struct(mb(F.sum("rss") / total).alias("avg_mb"), mb(F.max("most")).alias("peak_mb")).alias("rss"),
        F.array_sort(F.collect_list(point)).alias("chart"),
    ).where("samples > 0")


def write_footprint(samples: DataFrame, order: list[str], path: str) -> None:
    """The document as a file of JSON, written aside and renamed; an error for no samples."""
    row = footprint(samples, order).toJSON().first()  # one document of at most POINTS points
    if row is None:
        raise ValueError("no valid samples")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(json.dumps(json.loads(row), indent=2) + "\n")
    os.replace(path + ".tmp", path)
