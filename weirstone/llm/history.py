"""Problem 6: new batches against all history, by a persisted inverted-file index of reading vectors.

A reading is the vector (axis of its station, seconds since 1970); the axes of two stations are further apart than any
search radius. Vectors fall into cells of `CELL_US` along their axis. The index is a folder of Parquet tables by generation
(one per batch) and span of cells:

- `vectors`: full vectors, not codes, with their cell;
- `cells`: the list of cells, each with the centroid of its vectors, its radius (how far the furthest of them is) and their number.

A batch is appended, and then probed in two steps. Its own cells are held against the cell lists of earlier generations: a
listed cell is probed if its distance bound, max(0, |centroid - centroid| - radius - radius), is within the search radius,
however many cells that is; in no other can a match lie. Then only vectors of probed cells are read, from the spans and
generations that hold any, and compared exactly. Neither step reads the history as a whole, and a repeated probe gives the
same answer: what a further batch costs depends on how much history it touches, not on how much there is.

Defined results: rows of unknown stations or without an instant are neither queries nor history; of rows with the same
vector all but the one of the least sample_id are repeats; extra columns are ignored; empty batches append nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirstone.readings import readable
from weirstone.shared import dimension, shared_path

RADIUS_US = 3_000_000
CELL_US = 6 * 3_600_000_000
SPAN_CELLS = 120
BATCHES = 4
VECTOR = "sid int, cell bigint, t_us bigint, sample_id bigint, gen int, span int"
CELL = "sid int, cell bigint, n bigint, centroid double, radius double, gen int, span int"


class History:
    """The index under `path`; one process appends at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None, radius_us: int = RADIUS_US) -> None:
        self.spark, self.path, self.radius_us = spark, path or shared_path(spark, "history"), radius_us

    def append(self, batch: DataFrame, gen: int) -> None:
        """batch: sid, t_us, sample_id, all sample_ids above those of earlier generations. Writing a generation again replaces it."""
        cell = F.floor(F.col("t_us") / CELL_US)
        rows = batch.select("sid", cell.alias("cell"), "t_us", "sample_id", F.floor(cell / SPAN_CELLS).cast("int").alias("span"))
        self._put(rows, "vectors", gen)
        near = F.struct(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
        cells = self.vectors().where(F.col("gen") == gen).groupBy("span", "sid", "cell").agg(F.count("*").alias("n"), F.avg("t_us").alias("centroid"), near.alias("e"))
        radius = F.greatest(F.col("e.hi") - F.col("centroid"), F.col("centroid") - F.col("e.lo"))
        self._put(cells.select("sid", "cell", "n", "centroid", radius.alias("radius"), "span"), "cells", gen)

    def _put(self, rows: DataFrame, what: str, gen: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("span").parquet(f"{self.path}/{what}/gen={gen}")

    def _read(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}")

    def vectors(self) -> DataFrame:
        return self._read("vectors", VECTOR)

    def cells(self) -> DataFrame:
        return self._read("cells", CELL)

    def probed(self, gen: int) -> DataFrame:
        """sid, cell, gen, span of the cells of earlier generations in which a vector of generation `gen` can have a match."""
        own = self.cells().where(F.col("gen") == gen)
        reach = F.col("radius") + self.radius_us + 1.0  # centroids are rounded to floating point
        low, high = F.floor((F.col("centroid") - reach) / CELL_US), F.floor((F.col("centroid") + reach) / CELL_US)
        asked = own.select("sid", F.explode(F.sequence(low, high)).alias("cell"), F.col("centroid").alias("c"), F.col("radius").alias("r"))
        spans = [r[0] for r in asked.select(F.floor(F.col("cell") / SPAN_CELLS).cast("int")).distinct().collect()]  # one number per 30 days that the batch touches
        listed = self.cells().where((F.col("gen") < gen) & F.col("span").isin(spans))
        bound = F.abs(F.col("centroid") - F.col("c")) - F.col("radius") - F.col("r") - 1.0
        return listed.join(asked, ["sid", "cell"]).where(bound <= self.radius_us).select("sid", "cell", "gen", "span").distinct()

    def repeats(self, gen: int) -> DataFrame:
        """sample_id of each row of generation `gen` for which a row of smaller sample_id lies within the radius."""
        pool = self._around(self.vectors().where(F.col("gen") == gen)).withColumn("mine", F.lit(True))
        if gen:
            cells = self.probed(gen)
            held = [tuple(r) for r in cells.select("gen", "span").distinct().collect()]  # generations by spans of 30 days, bounded by time
            old = self.vectors().where(F.col("gen").isin([g for g, _ in held]) & F.col("span").isin([s for _, s in held]))
            old = old.join(dimension(cells.select("sid", "cell", "gen")), ["sid", "cell", "gen"], "left_semi")
            pool = pool.unionByName(self._around(old).withColumn("mine", F.lit(False)))
        near = Window.partitionBy("sid", "cell").orderBy("t_us").rangeBetween(-self.radius_us, self.radius_us)
        least = pool.withColumn("least", F.min("sample_id").over(near))
        return least.where("mine and core and least < sample_id").select("sample_id")

    def _around(self, rows: DataFrame) -> DataFrame:
        """Each vector in its own cell (core) and in all others within the radius."""
        cells = F.sequence(F.floor((F.col("t_us") - self.radius_us) / CELL_US), F.floor((F.col("t_us") + self.radius_us) / CELL_US))
        return rows.select("sid", "t_us", "sample_id", F.col("cell").alias("own"), F.explode(cells).alias("cell")).withColumn("core", F.col("cell") == F.col("own")).drop("own")


def in_batches(rows: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """rows (sample_id, window_id, ...) in order of arrival, cut into whole windows (by their first row); about equal ranges of sample_id."""
    first = rows.groupBy("window_id").agg(F.min("sample_id").alias("i"))
    ends = rows.agg(F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi")).first()
    if ends["lo"] is None:
        return [rows]
    step = (ends["hi"] - ends["lo"]) // batches + 1
    cuts = first.agg(*[F.min(F.when(F.col("i") >= ends["lo"] + k * step, F.col("i"))).alias(f"c{k}") for k in range(1, batches)]).first() if batches > 1 else ()
    at = [ends["lo"], *[ends["hi"] + 1 if c is None else c for c in cuts], ends["hi"] + 1]
    return [rows.where((F.col("sample_id") >= a) & (F.col("sample_id") < b)) for a, b in zip(at, at[1:])]


def deduplicated(samples: DataFrame, stations: DataFrame, batches: int = BATCHES, path: str | None = None) -> DataFrame:
    """Feeds samples to a new index in order of arrival; sample_id of the rows that aren't accepted."""
    history = History(samples.sparkSession, path)
    found = None
    for gen, batch in enumerate(in_batches(samples.select("sample_id", "station_id", "timestamp", "value", "window_id"), batches)):
        history.append(readable(batch, stations).select("sid", "t_us", "sample_id"), gen)
        out = history.repeats(gen)
        found = out if found is None else found.unionByName(out)
    return found


def p6_found(samples: DataFrame, stations: DataFrame) -> DataFrame:
    return deduplicated(samples, stations)


def p6_accepted(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """window_id, n_rows, n_repeats: how much of every batch is accepted (rows without an instant are, as they repeat none)."""
    gone = deduplicated(samples, stations).withColumn("gone", F.lit(1))
    return samples.select("sample_id", "window_id").join(gone, "sample_id", "left").groupBy("window_id").agg(F.count("*").alias("n_rows"), F.count("gone").alias("n_repeats"))
