"""Memory of a scoring task and the size of the batches that reach it."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickfeat.llm import common, toxic_cnn

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def model():
    rng = np.random.default_rng(1)
    texts = [b" ".join([b"bad" if i % 2 else b"good"] * 3 + [b"w%d" % k for k in rng.integers(0, 50, 20)]) for i in range(60)]
    return toxic_cnn.fit(texts, np.array([float(i % 2) for i in range(60)]))


def test_scoring_takes_a_few_mb_at_a_time():
    """1.9 MB of short texts in one batch: peak memory is that of a small chunk, every row gets the score it has alone."""
    m = model()
    texts = [b"bad w1 w%d some a b c d e f g " % i * (1 + i % 3) for i in range(30_000)]
    n = len(texts)
    batch = pa.record_batch({"doc_id": pa.array(range(n)), "held_out": pa.array([False] * n), "lang": pa.array(["en"] * n),
                             "print": pa.array([0] * n), "text": pa.array(texts, pa.binary())})
    tasks = toxic_cnn._score_rows(toxic_cnn._packed(m))
    next(iter(tasks([batch.slice(0, 10)])))  # powers of the hash are there
    tracemalloc.start()
    ids, scores = [], []
    for out in tasks([batch]):
        ids += out.column("doc_id").to_pylist()
        scores += out.column("score").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(n))
    assert peak < 100 << 20
    scorer = toxic_cnn.Scorer(m)
    for i in range(0, n, 997):
        assert scores[i] == pytest.approx(scorer(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))[0], rel=1e-5)


def test_stages_take_texts_in_small_batches(spark):
    docs = spark.range(2000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 5000).alias("text"))
    stage = corpus_pipeline._own_names(lambda spark, docs, sf_dir: docs)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.nbytes])})

    before = spark.conf.get(BOUND, None)
    try:
        spark.conf.unset(BOUND)
        got = [r["n"] for r in stage(spark, docs, "").mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 2000 * 10_000 and max(got) < 2 * common.BATCH_BYTES
        spark.conf.set(BOUND, "100000")
        stage(spark, docs, "")
        assert spark.conf.get(BOUND) == "100000"
    finally:
        spark.conf.unset(BOUND) if before is None else spark.conf.set(BOUND, before)
