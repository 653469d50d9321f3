"""Spark-side helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir


def importable(spark: SparkSession) -> None:
    """Let the session's Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (root, known.get("PYTHONPATH")) if x)


#: Bytes of an Arrow batch on its way to a Python task, about.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python tasks in Arrow batches of about ``BATCH_BYTES``, whatever the length of their texts (10,000 rows are tens
    of MB on either side of a task otherwise). A bound that the session has already stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join: a table that grows with the input is never collected by the driver and broadcast,
    however small it is (a plan of many joins leaves a table, its blocks and a thread of each there)."""
    return df.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch` named, in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def as_bytes(name: str = "text") -> Column:
    """The text column as binary; nulls as empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit("").cast("binary")).alias(name)


def fingerprint(name: str = "text") -> Column:
    """Hash of the text (null as empty): with the id it tells rows apart whose ids are equal or null."""
    return F.xxhash64(as_bytes(name))


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text modulo ``modulus`` is ``remainder`` (a null id counts as empty text)."""
    crc = F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return crc % F.lit(modulus) == F.lit(remainder)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total bytes of a text column (one number)."""
    return docs.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0


def shard_count(total: int, each: int, least: int = 12) -> int:
    """Number of hash shards so that each gets about ``each`` bytes of text."""
    return max(least, math.ceil(total / each))
