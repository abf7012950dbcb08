"""Epoch-aligned windows, what they hold, and where their files go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.operators.dedupe import epoch_s


def align(unix_s: Column, width_s: int) -> Column:
    """Start of the window of width_s seconds that holds the instant, also before 1970."""
    return unix_s - F.pmod(unix_s, F.lit(max(1, int(width_s))))


def instant(unix_s: Column) -> Column:
    """Timestamp without zone of seconds since 1970."""
    return F.timestamp_add("SECOND", unix_s, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def assigned(rows: DataFrame, ts: str, width_s: int) -> DataFrame:
    start = align(epoch_s(F.col(ts)), width_s)
    return rows.withColumn("window_start", instant(start)).withColumn("window_end", instant(start + max(1, int(width_s))))


def object_path(pipeline: Column, start: Column) -> Column:
    """Hour path of a window; what shares an hour shares the path."""
    return F.concat(F.lit("data/"), pipeline, F.lit("/"), F.date_format(start, "yyyy-MM-dd"), F.lit("/"), F.date_format(start, "HH"), F.lit(".parquet"))


def path_collisions(windows: DataFrame) -> DataFrame:
    """windows: pipeline, window_start. Paths that more than one window would write, with how many would be overwritten."""
    paths = windows.select("pipeline", "window_start").distinct().withColumn("path", object_path(F.col("pipeline"), F.col("window_start")))
    return paths.groupBy("path").agg(F.count("*").alias("n_windows")).where("n_windows > 1").withColumn("n_overwritten", F.col("n_windows") - 1)


def last_writer(windows: DataFrame) -> DataFrame:
    """The window whose file stays at each path if later ones replace earlier ones."""
    return windows.withColumn("path", object_path(F.col("pipeline"), F.col("window_start"))).groupBy("path").agg(F.max("window_start").alias("window_start"))


def flush_order(windows: DataFrame) -> DataFrame:
    """Windows of each pipeline numbered oldest first."""
    return windows.withColumn("n", F.row_number().over(Window.partitionBy("pipeline").orderBy("window_start")).cast("bigint"))
