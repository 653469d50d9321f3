"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import held_out

#: Labelled rows a classifier learns from, at most (smallest id hashes first).
SAMPLE_ROWS = 20_000


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the training ids: an id that is labelled several times takes its largest label; null labels and ids
    do not train."""
    return labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(4, 2)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, n: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of at most ``n`` ids of ``rows`` (doc_id, ...) with their ``label``, from training ids only.

    An id that is labelled several times takes its largest label; null labels and ids do not train, and labelled ids
    that ``rows`` does not have take no place.
    """
    known = known_labels(labels, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    there = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = there.orderBy(*order).limit(n)
    return rows.join(F.broadcast(chosen), "doc_id")  # at most n rows of two numbers
