"""What every operator needs of the cluster: the shared folder, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Rows and bytes up to which a dimension may be broadcast; beyond either, the join is left to shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one in local mode only (tests), as executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_weirstone_root", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            root = spark._weirstone_root = "file://" + tempfile.mkdtemp(prefix="weirstone-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/weirstone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cuts the lineage of df with a table in the shared folder, which survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(df: DataFrame) -> Column:
    """Bytes of a row: of texts and arrays what they hold, 8 of anything else."""
    size = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, StringType | BinaryType):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 16
        elif isinstance(kind, ArrayType):
            size = size + F.greatest(F.size(f"`{f.name}`"), F.lit(0)) * 16 + 16
        else:
            size = size + 8
    return size.cast("bigint")


def dimension(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df for broadcast if a count proves that it has at most `limit` rows of `limit_bytes` together, else leaves it alone. df is evaluated for that: give a table, or what is cheap."""
    got = df.limit(limit + 1).agg(F.count("*").alias("n"), F.sum(_width(df)).alias("b")).first()
    return F.broadcast(df) if got["n"] <= limit and (got["b"] or 0) <= limit_bytes else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
