"""A training-corpus pipeline over the ``documents`` table: five stages, each an operator of ``clickfeat.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the next
stage's input. The first four return the columns of ``documents``:

1. ``toxicity``: documents that the classifier flags (score at the threshold of their language or above) go.
2. ``near_duplicates``: of each component of near copies one row stays: the smallest id's (null ids last; of rows that
   share this id, the one with the smallest fingerprint of its text); documents without words are no copies of each
   other and stay.
3. ``benchmark``: documents that leak a benchmark item go.
4. ``secrets``: spans of secrets are replaced by a mark; ``n_chars`` follows the text.
5. ``mix``: sources are brought to their target weights; documents that are not taken go, the others carry
   ``copies``, the number of times the mix takes them (an input column of this name gives way to it).

Odd input follows the operators: null texts stay as they are (stage 5 drops them, as they have no words). Verdicts of
stages 1-3 travel by id (null-safely) and fingerprint of the text, so rows with repeated or null ids each get their own.
Columns that no stage knows have generated names while one works, so theirs may be any. An empty table stays empty.
The folder of a stage is removed when the next one is written.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickfeat.llm.common import documents, fingerprint, remove, scratch, small_batches, written
from clickfeat.llm.cube_mix import mix_sources
from clickfeat.llm.decontam import leaking_rows
from clickfeat.llm.learning import labels
from clickfeat.llm.ngram_join import component_rows
from clickfeat.llm.secret_scan import find_secrets, redacted
from clickfeat.llm.toxic_cnn import verdicts

KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _own_names(stage):
    """``stage`` with all columns but the known ones under generated names, its texts in small batches."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        held = [c if c in KNOWN else f"__other_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*held), sf_dir)
        new = [c for c in out.columns if c not in held]
        back = [F.col(h).alias(c) for h, c in zip(held, docs.columns) if c not in new]
        return out.select(*back, *new)
    return run


def _print(docs: DataFrame) -> DataFrame:
    """A fingerprint of the text beside the id: what tells rows with equal ids apart."""
    return docs.withColumn("_print", F.xxhash64("text"))


def _same(docs: DataFrame):
    """Rows of ``docs`` against the ``_id`` and ``_of`` (fingerprint of the text) of a verdict."""
    return docs["doc_id"].eqNullSafe(F.col("_id")) & (fingerprint() == F.col("_of"))


def _without(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not in ``verdict`` (doc_id, print)."""
    other = verdict.select(F.col("doc_id").alias("_id"), F.col("print").alias("_of")).distinct()
    return docs.join(other, _same(docs), "left_anti")


@_own_names
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, verdicts(docs, labels(spark, sf_dir)).filter("flagged"))


@_own_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = component_rows(docs).filter("n_shingles > 0")
    # one row per id and text that is a copy, or that several rows share
    verdict = written(found.groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_of")).agg(
        F.max(~F.col("first")).alias("_copy"), (F.count("*") > 1).alias("_shared")).filter("_copy or _shared"), "join-copies")
    rows = docs.join(verdict, _same(docs), "left").filter("not coalesce(_copy, false)")
    once = rows.filter("_shared").dropDuplicates(["_id", "_of"])
    return rows.filter("_shared is null").select(*docs.columns).unionByName(once.select(*docs.columns))


@_own_names
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, leaking_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("leaked"))


@_own_names
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("all_spans")))
    out = find_secrets(docs).withColumn("_clean", clean)
    changed = F.size("all_spans") > 0
    columns = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("_clean").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(columns).select(*docs.columns)


@_own_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mix_sources(docs).filter("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("fingerprint").alias("_fp"),
        (F.col("taken") / F.col("size")).cast("int").alias("_taken"))
    # equal rows become one row with the sum of their copies
    taken = taken.groupBy("_id", "_source", "_fp").agg(F.sum("_taken").cast("int").alias("_copies"))
    rows = _print(docs).dropDuplicates(["doc_id", "source", "_print"])
    same = F.expr("doc_id <=> _id and source <=> _source and _print = _fp")
    return rows.join(taken, same).select(*docs.columns, F.col("_copies").alias("copies"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("secrets", mask_secrets),
    ("mix", mix),
]

#: The classifier's scores and the balanced draw cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
