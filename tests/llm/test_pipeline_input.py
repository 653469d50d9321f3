"""The pipeline on clashing names and empty tables; toxicity by language and its thresholds."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickfeat.llm import toxic_cnn
from clickfeat.llm.common import documents
from clickfeat.llm.learning import labels

SF = "/root/testdata/sf0.001"
NAMES = ("_id", "_of", "_copy", "_shared", "_clean", "_source", "_taken", "_copies", "_print", "_fp", "k1", "k2", "print", "first", "flagged", "leaked",
         "all_spans", "size", "taken", "target", "fingerprint", "score", "rules", "hash", "cls", "held_out", "__other_3", "label", "threshold")


def tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0 if docs.isEmpty() else 10**9).write.parquet(f"{path}/{name}.parquet")


def test_extra_columns_may_have_any_name(spark, tmp_path):
    """The same rows come out with thirty more columns, whose values travel with their rows."""
    plain = documents(spark, SF)
    wide = plain.withColumns({n: F.concat(F.lit(n + " of "), F.col("doc_id").cast("string")) for n in NAMES})
    sf = str(tmp_path)
    tables(spark, sf, wide)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*wide.columns, "copies"]
    want = corpus_pipeline.run(spark, SF)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    for n in NAMES:
        assert got.filter(F.col(n) != F.concat(F.lit(n + " of "), F.col("doc_id").cast("string"))).isEmpty()


def test_an_input_column_named_copies_gives_way(spark, tmp_path):
    sf = str(tmp_path)
    tables(spark, sf, documents(spark, SF).limit(50).withColumn("copies", F.lit("x")))
    got = corpus_pipeline.run(spark, sf)
    assert got.columns.count("copies") == 1 and dict(got.dtypes)["copies"] == "int"


def test_empty_tables(spark, tmp_path, odd):
    for k, docs in enumerate((documents(spark, SF).limit(0), odd.limit(0))):
        sf = str(tmp_path / str(k))
        tables(spark, sf, docs)
        got = corpus_pipeline.run(spark, sf)
        assert got.collect() == [] and got.columns == [*docs.columns, "copies"]


def test_only_the_last_stage_is_kept(spark):
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    stages = lambda: {d for d in os.listdir(base) if d.startswith("pipeline-")}
    before = stages()
    out = corpus_pipeline.run(spark, SF)
    new = stages() - before
    assert len(new) == 1 and next(iter(new)).startswith("pipeline-mix") and out.count()


def test_toxic_recall_by_language_on_held_out_rows(spark):
    """Rows that did not train, whole table of sf0.1: the verdict that the pipeline uses, by language."""
    sf = "/root/testdata/sf0.1"
    known = labels(spark, sf).filter("toxic is not null").select("doc_id", "toxic")
    rows = toxic_cnn.toxicity(documents(spark, sf), labels(spark, sf)).join(known, "doc_id").filter("held_out").groupBy("lang").agg(
        F.sum("toxic").alias("toxic"), F.sum(F.expr("if(flagged and toxic = 1, 1, 0)")).alias("caught"),
        F.sum(1 - F.col("toxic")).alias("clean"), F.sum(F.expr("if(flagged and toxic = 0, 1, 0)")).alias("wrong")).collect()
    assert {r["lang"] for r in rows} == {"en", "de", "fr", "es"}
    for r in rows:
        assert r["caught"] >= 0.8 * r["toxic"] and r["wrong"] <= 0.04 * r["clean"], r


def test_thresholds_by_language_and_pool():
    y = np.array(([0] * 25 + [1] * 25) * 2 + [0, 1] * 15)
    base = np.concatenate([np.where(y[:50] == 1, 0.9, 0.6), np.where(y[50:100] == 1, 0.4, 0.1), np.where(y[100:] == 1, 0.8, 0.3)])
    langs = ["a"] * 50 + ["b"] * 50 + ["c", "c", "d", "d"] * 7 + ["c", "d"]
    by_lang, other = toxic_cnn.calibrate(base, y, langs, least=15)
    assert set(by_lang) == {"a", "b"} and by_lang["a"] == pytest.approx(0.75) and by_lang["b"] == pytest.approx(0.25)
    assert other == pytest.approx(0.55)  # c and d together
    assert toxic_cnn.calibrate(base[:4], y[:4], ["a"] * 4) == ({}, toxic_cnn.CUTOFF)
    by_lang, other = toxic_cnn.calibrate(base[:54], y[:54], ["a"] * 50 + ["c"] * 4, least=15)
    assert other == pytest.approx(0.75) or 0.6 < other <= 0.9  # too few of c alone: all rows


def test_long_and_missing_training_texts(spark):
    """A text longer than the bound of one text is passed over, and the sample is complete without it."""
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "kind ") * 20, "en") for i in range(200)] + [(1000, "kind " * 300_000, "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1000, 1)], "doc_id long, toxic int")
    got = toxic_cnn.toxicity(docs, marks).filter("flagged").select("doc_id").collect()
    assert sorted(r[0] for r in got) == list(range(1, 200, 2))
