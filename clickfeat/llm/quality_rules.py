"""Quality rules: exact text counts, and the perplexity of a byte n-gram model with bands by language.

The model is interpolated modified Kneser-Ney over byte 4-grams. Spark counts the 4-grams of all texts (tasks
send their distinct grams with counts), derives the continuation counts, discounts and probabilities of every
order as joins of those small tables, and a last step writes one sorted hash array of keys with log10 values
(``arraystore``). Scoring tasks map it and look up the distinct grams of each chunk.

A language's band is its quartiles of log10 perplexity widened by ``WIDTH`` quartile ranges; the band of a
short text is wider (by ``sqrt(1 + SHORT / bytes)``), as its mean is less sure. A text outside its band, or one
that fails the base rules, is not kept.

Odd input: a null or empty text has no words and fails the base rules (perplexity null); a null language has a
band of its own; repeated rows each keep their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as tx, textstats as ts
from .arraystore import Lookup, put
from .common import as_bytes, documents, scratch, written
from .kn_lm import discounts

ORDER = 4
WIDTH = 2.5
SHORT = 1500.0
#: No band is narrower than this (log10 perplexity), for languages with few or equal texts.
LEAST_RANGE = 0.02
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: Distinct grams of one array file.
SHARD_GRAMS = 8_000_000


def byte_grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; texts begin after newlines."""
    pad = order - 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + pad * (doc + 1)
    line = np.full(len(data) + pad * (len(offsets) - 1), 10, np.uint8)
    line[at] = data
    code = np.zeros(len(data), np.uint32)
    for k in range(pad, -1, -1):
        code = (code << np.uint32(8)) | line[at - k]
    return code


def _count(batches):
    keys, counts, size = [], [], 0

    def merged():
        k, back = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(back, np.concatenate(counts), minlength=len(k)).astype(np.int64)

    for batch in batches:
        for _, _, data, offsets in tx.text_chunks(batch):
            if not len(data):
                continue
            k, n = np.unique(byte_grams(data, offsets), return_counts=True)
            keys.append(k)
            counts.append(n)
            size += len(k)
            if size > 4_000_000:
                k, n = merged()
                keys, counts, size = [k], [n], len(k)
                if size > 2_000_000:
                    yield pa.record_batch({"g": pa.array(k.astype(np.int64)), "c": pa.array(n)})
                    keys, counts, size = [], [], 0
    if keys:
        k, n = merged()
        yield pa.record_batch({"g": pa.array(k.astype(np.int64)), "c": pa.array(n)})


def _deal(shards):
    def run(batches):
        for batch in batches:
            h = tx.mix(np.asarray(batch.column("key")).astype(np.uint64))
            yield pa.record_batch({"shard": pa.array(tx.shard_of(h, shards).astype(np.int32)), "hash": pa.array(h.view(np.int64)),
                                   "value": batch.column("value")})
    return run


def _store(uri):
    def run(table):
        shard = table.column("shard")[0].as_py()
        key = np.asarray(table.column("hash")).view(np.uint64)
        order = np.argsort(key)
        put(uri, "key", shard, key[order])
        put(uri, "value", shard, np.asarray(table.column("value")).astype(np.float32)[order])
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(key)], pa.int64())})
    return run


def train_bytes(texts: DataFrame, uri: str) -> dict:
    """Model over all texts. Key ``order << 32 | gram``: log10 probability; ``(order + 8) << 32 | context``: log10 weight."""
    counts = {ORDER: written(texts.mapInArrow(_count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")), "rules-grams")}
    for k in range(ORDER - 1, 0, -1):
        # a lower order counts the distinct bytes before it
        counts[k] = written(counts[k + 1].groupBy(F.col("g").bitwiseAND((1 << (8 * k)) - 1).alias("g")).agg(F.count("*").alias("c")), "rules-grams")
    prob, entries = None, []
    for k in range(1, ORDER + 1):
        some = counts[k].agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        d = discounts([x or 0 for x in some])
        less = F.greatest(F.col("c") - F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]), F.lit(0.0))
        ctx = F.shiftright("g", 8)
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        sums = counts[k].groupBy(ctx.alias("h")).agg(F.sum("c").alias("total"), F.sum(taken).alias("freed")).withColumn(
            "gamma", F.col("freed") / F.col("total"))
        rows = counts[k].withColumn("h", ctx).join(sums, "h")
        if prob is None:
            p = less / F.col("total") + F.col("gamma") / 256
            rows = rows.select("g", p.alias("p"))
        else:
            lower = prob.select(F.col("g").alias("low"), F.col("p").alias("q"))
            rows = rows.withColumn("low", F.col("g").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(lower, "low").select(
                "g", (less / F.col("total") + F.col("gamma") * F.col("q")).alias("p"))
        prob = written(rows, "rules-probs")
        entries.append(prob.select((F.col("g") + F.lit(k << 32)).alias("key"), F.log10("p").alias("value")))
        entries.append(sums.select((F.col("h") + F.lit((k + 8) << 32)).alias("key"), F.log10("gamma").alias("value")))
    table = entries[0]
    for e in entries[1:]:
        table = table.union(e)
    table = written(table, "rules-model")
    shards = max(1, -(-table.count() // SHARD_GRAMS))
    dealt = table.mapInArrow(_deal(shards), "shard int, hash long, value double")
    dealt.groupBy("shard").applyInArrow(_store(uri), "shard int, n long").collect()
    return {"uri": uri, "shards": shards}


class ByteScorer:
    """log10 probability of each byte gram: its own order, else weight times the lower order."""

    def __init__(self, model: dict):
        self.table = Lookup(model["uri"], "key", {"value": np.float32}, model["shards"], lambda h: tx.shard_of(h, model["shards"]))

    def _find(self, keys):
        found, value = self.table.find(tx.mix(keys.astype(np.uint64)))
        return found, value["value"]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        asked, back = np.unique(codes, return_inverse=True)
        asked = asked.astype(np.int64)
        out, todo, weight = np.zeros(len(asked)), np.arange(len(asked)), np.zeros(len(asked))
        for k in range(ORDER, 0, -1):
            part = asked[todo] & ((1 << (8 * k)) - 1)
            ok, v = self._find(part + (k << 32))
            out[todo[ok]] = v[ok] + weight[todo[ok]]
            todo, part = todo[~ok], part[~ok]
            if not len(todo):
                break
            ok, v = self._find((part >> 8) + ((k + 8) << 32))
            weight[todo[ok]] += v[ok]
        out[todo] = weight[todo] - np.log10(256.0)
        return out[back]


_OUT = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "n_bytes long, log_perplexity double")


def _rules(model):
    def run(batches):
        scorer = ByteScorer(model)
        for batch in batches:
            for lo, hi, data, offsets in tx.text_chunks(batch):
                w = tx.split_words(data, offsets)
                n = np.diff(offsets)
                logp = np.zeros(len(data) + 1)
                if len(data):
                    np.cumsum(scorer(byte_grams(data, offsets)), out=logp[1:])
                total = logp[offsets[1:]] - logp[offsets[:-1]]
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo), "lang": batch.column("lang").slice(lo, hi - lo),
                    "n_words": pa.array(w.counts.astype(np.int64)), "word_chars": pa.array(ts.code_points(w)),
                    "n_symbols": pa.array(ts.byte_sum(ts.SYMBOLS[data], offsets)),
                    "n_dup_lines": pa.array(ts.duplicate_lines(data, offsets).astype(np.int64)),
                    "n_repeat_words": pa.array(ts.repeated_words(w, REPEAT_WINDOW)), "n_bytes": pa.array(n),
                    "log_perplexity": pa.array(-total / np.maximum(n, 1), mask=n == 0)})
    return run


def quality_rules(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """Counts, perplexity, band and verdict of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), as_bytes())
    model = train_bytes(rows.select("text"), scratch(docs.sparkSession, "rules-model"))
    counted = written(rows.mapInArrow(_rules(model), _OUT), "rules-counts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    bands = counted.groupBy(F.col("lang").alias("band")).agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10000).alias("q"))
    spread = F.greatest(F.element_at("q", 2) - F.element_at("q", 1), F.lit(LEAST_RANGE)) * width * F.sqrt(1 + F.lit(SHORT) / F.greatest("n_bytes", F.lit(1)))
    out = counted.join(bands, F.col("lang").eqNullSafe(F.col("band")), "left").withColumn("base_failed", failed).withColumn(
        "lower", F.pow(F.lit(10.0), F.element_at("q", 1) - spread)).withColumn("upper", F.pow(F.lit(10.0), F.element_at("q", 2) + spread)).withColumn(
        "perplexity", F.pow(F.lit(10.0), "log_perplexity"))
    inside = F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & inside).alias("kept"), "lang", "perplexity", "lower", "upper")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
