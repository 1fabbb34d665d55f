"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds a worker's memory.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Without one, a temporary folder is set in local mode (as in tests); on a cluster this raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote and that nothing lazy reads any more."""
    at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: A key is hot from this many rows on, and from a thousandth of all rows on.
HOT = 200


def hot_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Joins ``many`` with ``few``, which has one row for each ``key``, without a task for a hot key.

    Rows of a hot key are dealt to parts by their hash, and its row in ``few`` goes to each part. Fewer than
    1000 keys can each hold more than a thousandth of the rows, so their list has a bounded size. counts: rows
    of ``many`` by key, as column m, where they are known.
    """
    most = max(HOT, many.count() // 1000)
    counts = many.groupBy(key).agg(F.count("*").alias("m")) if counts is None else counts
    hot = counts.where((F.col("m") > most) & F.col(key).isNotNull()).select(key, F.ceil(F.col("m") / most).cast("int").alias("__parts")).collect()
    if not hot:
        return many.join(few, key, how)
    parts = F.broadcast(many.sparkSession.createDataFrame(hot, many.select(key, F.lit(0).alias("__parts")).schema))
    dealt = many.join(parts, key, "left").withColumn("__part", F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    each = few.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(each, [key, "__part"], how).drop("__part")


def n_parts(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Partitions for a shuffle of about the size of ``df``: it grows with the optimizer's size estimate.

    Where the optimizer knows no size (rows from the driver, an RDD), there are as many as before.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, df.rdd.getNumPartitions() if size >= 1 << 55 else min(size // bytes_each, 200_000))


def filled(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def release() -> None:
    """Gives a worker's free memory back to the system; workers live on between stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass
