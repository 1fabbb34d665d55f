"""A corpus pipeline of five stages, each one of the operators in fieldspark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import shared_dir
from fieldspark.llm.decontaminate import decontaminate
from fieldspark.llm.line_dedup import dedup_lines
from fieldspark.llm.minhash import near_duplicates
from fieldspark.llm.packing import pack
from fieldspark.llm.quality import classify

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: five words and a similarity of 0.8.
SHINGLE_WORDS, PERCENT = 5, 80


def _lean(spark: SparkSession) -> None:
    """Rows of texts go to workers in small batches, for workers and executors serve all stages in turn.

    The plans are lazy, so the option stays with the session; one that the session has set itself is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def _columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, toxic ones too."""
    _lean(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, keep=COLUMNS[1:], reject_toxic=True).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that lose all they show."""
    _lean(spark)
    return _columns(dedup_lines(docs, keep=("lang", "source")).where(r"n_dropped = 0 or text rlike '\\S'"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    _lean(spark)
    gone = near_duplicates(docs, SHINGLE_WORDS, PERCENT).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark phrases go, and documents that lose all they show."""
    _lean(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _columns(decontaminate(docs, items, keep=("lang", "source")).where(r"n_hit = 0 or text rlike '\\S'"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("minhash", near), ("decontaminate", benchmark), ("packing", packing)]

#: Hashing, Gumbel sampling and tokenising have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
