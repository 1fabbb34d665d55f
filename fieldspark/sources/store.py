"""Intermediate tables in the folder that driver and executors share, and dense numbering."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns the table."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str, name: str, first: int = 0) -> DataFrame:
    """(key, name): the distinct values of ``key`` numbered from ``first`` in their order.

    Values are sorted in ranges; a range's numbers start after the rows of the ranges before it.
    """
    own = df.select(key).distinct().repartitionByRange(F.col(key)).sortWithinPartitions(key)
    own = stored(own.select(key, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__k")), "numbered")
    ranges = own.groupBy("__p").agg(F.count("*").alias("__n"))  # one row for each partition
    before = ranges.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n") + first).alias("__base"))
    return own.join(F.broadcast(before), "__p").select(key, (F.col("__base") + F.col("__k")).cast("long").alias(name))


@contextmanager
def small_batches(spark: SparkSession, width: int):
    """For the actions inside, Arrow batches of at most some 32 MB where a row has ``width`` numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    most = max(1, (32 << 20) // (8 * max(width, 1)))
    spark.conf.set(key, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)
