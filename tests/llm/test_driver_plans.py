"""What the near-duplicate stage leaves with the driver: no copies of tables that grow with the input, no plan twice the size."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickfeat.llm import ngram_join


@pytest.fixture(scope="module")
def docs(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("text_id", i), F.lit(500)).cast("string"))))
    return spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 40).alias("text_id")).withColumn("text", words).drop("text_id")


def ran(df) -> tuple[list, str]:
    """Rows and the plan that made them."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return rows, plan.split("== Initial Plan ==")[0]


def test_growing_tables_are_joined_by_merge(spark, docs):
    rows, plan = ran(ngram_join.component_rows(docs))
    assert {(r["doc_id"], r["component_id"], r["first"]) for r in rows} == {(i, i % 40, i < 40) for i in range(60)}
    # the smallest document by component may be broadcast while it is small: its key can be hot
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= 1


def test_components_are_planned_once(spark, docs):
    rows, plan = ran(corpus_pipeline.drop_near_duplicates(spark, docs, ""))
    assert sorted(r["doc_id"] for r in rows) == list(range(40))
    assert len(re.findall(r"\w+Join", plan)) <= 2
