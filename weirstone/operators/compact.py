"""Problem 5: many tiny files into fewer, well-sized ones, every stored record exactly once.

1. `frozen` reads the stored files (`status = 200`) once and keeps their lines with their sample_id in a table of the shared
   folder, with the size and checksum of each file: the frozen manifest. All that follows reads this table, column by column.
2. `owners` finds the records with more than one line; the first line of the file with the least commit_id owns them.
3. `packed` puts the files of each pipeline into bins by first-fit decreasing, within chunks of neighbouring windows, so that
   no task sees the whole manifest. A bin's room is `target_bytes` of output: sizes are those of the files times the ratio
   at which the frozen table was compressed.
4. `compacted` writes each bin's records once into a staging folder, compares count and checksum of the records with what
   manifest and owners promise, their columns with their lines, and all lines with a second reading of the source, and commits
   by one rename. Only lines are shuffled; the columns read from them are made where they are written.

Defined results: a record is a complete JSON line with a `sample_id`; blank and cut-off lines, empty and null content
give none; a record is kept as its original line, with all keys, beside the four columns read from it; of the lines of a
record in one file the first counts; paths play no part, a file belongs to the pipeline of its
window (null without one); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirstone.shared import dimension, shared_path, written

TARGET_BYTES = 64 << 20
CHUNK_BINS = 16
CHUNK_FILES = 50_000
FIELDS = "station_id string, timestamp string, value double"


def stored(commits: DataFrame) -> DataFrame:
    return commits.where("status = 200").select("commit_id", "window_id", "content")


def _lines(files: DataFrame, *keep: str) -> DataFrame:
    """keep, pos, line of every line but blank ones; files without any come with nulls."""
    line = F.split(F.col("content").cast("string"), "\n")
    return files.select(*keep, F.posexplode_outer(line).alias("pos", "line")).where("pos is null or pos = 0 or trim(both ' \t\r' from line) != ''")


def frozen(commits: DataFrame) -> DataFrame:
    """commit_id, window_id, bytes, checksum (of the file), pos, line, sample_id (null: no record) of every line, kept as a table; each file has a row of pos 0 or null."""
    files = stored(commits).select("commit_id", "window_id", "content", F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("bytes"), F.xxhash64("content").alias("checksum"))
    of = F.from_json("line", "sample_id string")["sample_id"].try_cast("bigint")
    return written(_lines(files, "commit_id", "window_id", "bytes", "checksum").withColumn("sample_id", of), "frozen")


def records(lines: DataFrame) -> DataFrame:
    return lines.where("sample_id is not null")


def owners(lines: DataFrame) -> DataFrame:
    """lines: frozen. sample_id and the ascending array `at` of (commit_id, pos) of each record that has more than one line; the first owns it."""
    at = records(lines).select("sample_id", "commit_id", "pos").repartition("sample_id")
    often = at.withColumn("n", F.count("*").over(Window.partitionBy("sample_id"))).where("n > 1")
    return often.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("commit_id", "pos"))).alias("at"))


def shared_records(owned: DataFrame) -> DataFrame:
    """sample_id and the ascending array `files` of each record that lies in more than one file."""
    return owned.select("sample_id", F.array_distinct(F.transform("at", lambda x: x["commit_id"])).alias("files")).where("size(files) > 1")


def overlapping_files(shared: DataFrame) -> DataFrame:
    """shared: shared_records. commit_a < commit_b of files with a record in common. Equal sets of files are merged before pairs are made."""
    sets = shared.select("files").distinct()
    i = F.posexplode("files").alias("i", "commit_a")
    firsts = sets.select("files", i).repartition("commit_a")  # the pairs of a large set are made in many tasks
    return firsts.select("commit_a", F.explode(F.expr("slice(files, i + 2, size(files))")).alias("commit_b")).distinct()


def manifest(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """lines: frozen. commit_id, window_id, pipeline, bytes, checksum of every stored file."""
    of = dimension(windows.select("window_id", "pipeline").dropDuplicates(["window_id"]))
    files = lines.where("pos is null or pos = 0").select("commit_id", "window_id", "bytes", "checksum")
    return files.join(of, "window_id", "left").select("commit_id", "window_id", "pipeline", "bytes", "checksum")


def first_fit_decreasing(sizes: np.ndarray, room: int) -> np.ndarray:
    """The bin of each item; an item larger than `room` has a bin of its own."""
    out = np.zeros(len(sizes), dtype=np.int32)
    free: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        for b, left in enumerate(free):
            if size <= left:
                break
        else:
            b = len(free)
            free.append(max(room, size))
        free[b] -= size
        out[i] = b
    return out


def packed(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """files: a manifest; target_bytes in its bytes. Adds bin, a text unique within the pipeline."""
    totals = files.groupBy("pipeline").agg(F.sum("bytes").alias("total"), F.count("*").alias("n"), F.min("window_id").alias("lo"), F.max("window_id").alias("hi"))
    totals = totals.select(F.col("pipeline").alias("_p"), "lo", "hi", F.greatest(F.ceil(F.col("total") / (CHUNK_BINS * target_bytes)), F.ceil(F.col("n") / CHUNK_FILES), F.lit(1)).alias("chunks"))
    chunk = F.coalesce(F.floor((F.col("window_id") - F.col("lo")) * F.col("chunks") / (F.col("hi") - F.col("lo") + 1)), F.lit(0))
    rows = files.join(dimension(totals), F.col("pipeline").eqNullSafe(F.col("_p"))).select("commit_id", "pipeline", "bytes", "checksum", chunk.cast("int").alias("chunk"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("commit_id", kind="stable").reset_index(drop=True)
        bins = first_fit_decreasing(pdf["bytes"].to_numpy(), target_bytes)
        return pdf[["commit_id", "pipeline", "bytes", "checksum"]].assign(bin=[f"{c:06d}-{b:04d}" for c, b in zip(pdf["chunk"], bins)])

    return rows.groupBy("pipeline", "chunk").applyInPandas(pack, "commit_id bigint, pipeline string, bytes bigint, checksum bigint, bin string")


def compact(commits: DataFrame, windows: DataFrame, target: str | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Writes the compacted files under `target` (a new folder) and gives the report: pipeline, bin, n_files, bytes_in, n_records, checksum."""
    return compacted(commits, windows, target, target_bytes)[0]


def compacted(commits: DataFrame, windows: DataFrame, target: str | None = None, target_bytes: int = TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Compacts; the report of `compact`, and the `owners` that the run settled.

    Raises if what was written isn't what the manifest and the owners promise, or the source has changed; then nothing is committed.
    """
    spark = commits.sparkSession
    target = target or shared_path(spark, "compacted")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    staging = target.rstrip("/") + ".staging"
    fs = path_of(staging).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path_of(target)):
        raise RuntimeError(f"{target} exists")
    lines = frozen(commits)
    owned = written(owners(lines), "owners")
    files = written(manifest(lines, windows), "manifest")
    plan = written(packed(files, max(1, int(target_bytes / _ratio(spark, lines, files)))), "bins")
    lost = owned.select("sample_id", F.explode(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(1)))).alias("x")).select("sample_id", "x.commit_id", "x.pos")
    kept = records(lines).join(dimension(lost), ["sample_id", "commit_id", "pos"], "left_anti")
    n_bins = max(1, plan.select("pipeline", "bin").distinct().count())
    moved = kept.select("commit_id", "sample_id", "line").join(dimension(plan.select("commit_id", "pipeline", "bin")), "commit_id").repartition(n_bins, "pipeline", "bin")
    out = moved.withColumn("r", F.from_json("line", FIELDS)).select("sample_id", "r.*", "line", "pipeline", "bin")
    out.write.mode("errorifexists").option("compression", "zstd").partitionBy("pipeline", "bin").parquet(staging)
    back = spark.read.schema(out.schema).parquet(staging)
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    record, n_lost = F.xxhash64("sample_id", "line"), lost.count()
    sound = F.struct("station_id", "timestamp", "value").eqNullSafe(F.from_json("line", FIELDS))
    seen = back.agg(F.count("*").alias("n"), total(record).alias("c"), F.count(F.when(~sound, 1)).alias("bad")).first()
    owed = records(lines).agg(F.count("*").alias("n")).first()["n"] - n_lost, kept.agg(total(record)).first()[0]
    digest = lambda rows: rows.agg(F.count("*").alias("n"), total(F.xxhash64("commit_id", "pos", "line")).alias("c")).first()
    source, held = digest(_lines(stored(commits), "commit_id")), digest(lines)
    if source != held or (seen["n"], seen["c"]) != owed or seen["bad"]:
        fs.delete(path_of(staging), True)
        raise RuntimeError(f"compaction differs from its manifest: {seen} written, {owed} owed; lines of the source {source}, of the manifest {held}")
    if fs.exists(path_of(target)) or not fs.rename(path_of(staging), path_of(target)):  # renaming onto a folder would move into it
        fs.delete(path_of(staging), True)
        raise RuntimeError(f"could not commit {target}: it exists or can't be renamed")
    counts = spark.read.schema(out.schema).parquet(target).groupBy("pipeline", "bin").agg(F.count("*").alias("n_records"), total(record).alias("checksum"))
    sources = plan.groupBy("pipeline", "bin").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes_in"))
    same = sources["pipeline"].eqNullSafe(counts["pipeline"]) & (sources["bin"] == counts["bin"])
    report = sources.join(counts, same, "left").select(sources["pipeline"], sources["bin"], "n_files", "bytes_in", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.col("checksum").cast("string").alias("checksum"))
    return report, owned


def _ratio(spark: SparkSession, lines: DataFrame, files: DataFrame) -> float:
    """Bytes of the frozen table by byte of the files in it."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    folder = path_of(lines.inputFiles()[0]).getParent()
    held = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return held / max(1, files.agg(F.sum("bytes")).first()[0] or 1)


def p5_found(commits: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Pairs of files with a record in common, from the owners that a committed compaction settled; without windows, of files of no pipeline."""
    if windows is None:
        windows = commits.sparkSession.createDataFrame([], "window_id bigint, pipeline string")
    return overlapping_files(shared_records(compacted(commits, windows)[1]))
