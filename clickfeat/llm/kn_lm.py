"""Interpolated modified Kneser-Ney bigram model, counted by Spark over the whole corpus.

* Words are 64-bit hashes; ``END`` closes every text and ``START`` is the context of its
  first token. Spark counts words: tasks collapse what they hold, send packed pieces to
  hash shards, and each shard writes its sorted hash array and counts to the model folder
  (``arraystore``). A word's id is its place in those arrays.
* Then (context, word) pairs of ids are counted likewise, as sorted hash arrays. From its
  distinct pairs each shard sends, per word, how often it is a context (total and how many
  followers occur once, twice, more) and after how many contexts it stands; those numbers
  meet in the word's shard, in the order of its word array.
* Discounts come from the counts of counts of both levels (Chen and Goodman's modified
  estimates). The highest order is ``max(c - D(c), 0) / c(h) + gamma(h) P(w)``; ``P`` is the
  discounted continuation distribution, interpolated with a uniform one over V + 1 words.
* Scoring maps the arrays and looks up each chunk's distinct keys in order. A model of n
  pairs takes 12 bytes a pair in shared storage; a task holds only the pages it touches.

Odd input: null or empty texts are one END token; a null id counts as the empty id text
(crc32 0, so it is held out at any modulus of the query); repeated rows count repeatedly.
An empty training set gives every token the uniform probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as tx
from .arraystore import Lookup, put
from .common import as_bytes, documents, held_out, scratch, shard_count, text_bytes

#: Text bytes per shard of the model.
SHARD_BYTES = 32 << 20
#: Tokens that a task gathers before it collapses and sends them.
FLUSH_TOKENS = 2_000_000

_U = np.uint64
END, START = _U(0x5EED0E0D), _U(0x5EED57A7)
_PAIR = _U(0x9FB21C651E98DF25)

_PART = "shard int, a binary, b binary, n binary"
_PART_ARROW = pa.schema([("shard", pa.int32())] + [(c, pa.binary()) for c in ("a", "b", "n")])


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a pair of word ids."""
    return tx.mix(context.astype(np.uint64) * _PAIR + word.astype(np.uint64))


def token_stream(data: np.ndarray, offsets: np.ndarray):
    """(words, contexts, document of each token): the words of each text, then END."""
    w = tx.split_words(tx.LOWER[data], offsets)
    n_docs = len(offsets) - 1
    size = len(w.starts) + n_docs
    ends = w.first[1:] + np.arange(n_docs)
    tokens = np.empty(size, np.uint64)
    real = np.ones(size, bool)
    real[ends] = False
    tokens[real] = w.hash
    tokens[ends] = END
    contexts = np.empty(size, np.uint64)
    contexts[1:] = tokens[:-1]
    contexts[np.concatenate([[0], ends[:-1] + 1])] = START
    return tokens, contexts, np.repeat(np.arange(n_docs), w.counts + 1)


def _sum_by(key: np.ndarray, *values: np.ndarray):
    order = np.argsort(key)
    k = key[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return (k[start], *(np.add.reduceat(v[order], start) if len(k) else v for v in values))


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PART_ARROW.types)], schema=_PART_ARROW)


def _gather(batches, take):
    """Feed (tokens, contexts) of whole chunks to ``take`` in groups of about FLUSH_TOKENS."""
    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in tx.text_chunks(batch):
            held.append(token_stream(data, offsets)[:2])
            size += len(held[-1][0])
            if size >= FLUSH_TOKENS:
                yield take(*map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield take(*map(np.concatenate, zip(*held)))


def _count_words(shards):
    def take(tokens, _):
        key, n = np.unique(np.append(tokens, START), return_counts=True)
        n[np.searchsorted(key, START)] -= 1  # a context, not a token
        cut = np.searchsorted(tx.shard_of(key, shards), np.arange(shards + 1))
        return _batch([(int(s), tx.pack(key[cut[s]:cut[s + 1]], True), tx.pack(n[cut[s]:cut[s + 1]].astype(np.uint32)), b"")
                       for s in np.flatnonzero(np.diff(cut))])

    def run(batches):
        yield from _gather(batches, take)
    return run


def _count_pairs(model):
    def run(batches):
        words = Lookup(model["uri"], "word", {}, model["shards"], lambda h: tx.shard_of(h, model["shards"]), model["starts"])

        def take(tokens, contexts):
            kinds, back = np.unique(tokens, return_inverse=True)
            b = words.find(kinds)[1]["id"][back]
            # a context is the token before, or START
            a = np.empty_like(b)
            a[1:] = b[:-1]
            a[contexts == START] = words.find(np.array([START]))[1]["id"][0]
            del back, kinds
            # (context, word) as one sorted number: both are below the number of words
            pair, n = np.unique(a * np.int64(model["starts"][-1]) + b, return_counts=True)
            a, b = np.divmod(pair, np.int64(model["starts"][-1]))
            sh = tx.shard_of(pair_key(a, b), model["shards"])
            order = np.argsort(sh, kind="stable")
            cut = np.searchsorted(sh[order], np.arange(model["shards"] + 1))
            rows = []
            for s in np.flatnonzero(np.diff(cut)):
                o = order[cut[s]:cut[s + 1]]
                rows.append((int(s), tx.pack(a[o], True), tx.pack(b[o]), tx.pack(n[o])))
            return _batch(rows)

        yield from _gather(batches, take)
    return run


def _cat(table, column, kind, ordered=False):
    return np.concatenate([tx.unpack(v, kind, ordered) for v in table.column(column).to_pylist()])


def _spectrum(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


_STAT_COLUMNS = ("total", "kinds", "entries", "n1", "n2", "n3", "n4")
_STATS = "shard int, " + ", ".join(f"{c} long" for c in _STAT_COLUMNS)


def _stats(shard, total, kinds, entries, spectrum):
    return pa.table({"shard": pa.array([shard], pa.int32()), **{c: pa.array([int(v)], pa.int64()) for c, v in
                     zip(_STAT_COLUMNS, (total, kinds, entries, *spectrum))}})


def _store_words(uri):
    def run(table):
        shard = table.column("shard")[0].as_py()
        key, n = _sum_by(_cat(table, "a", np.uint64, True), _cat(table, "b", np.uint32).astype(np.int64))
        put(uri, "word", shard, key)
        put(uri, "word_n", shard, n)
        return _stats(shard, n.sum(), (n > 0).sum(), len(key), (0, 0, 0, 0))
    return run


def _store_pairs(model):
    """Write the pairs of a shard; send on what their words need as contexts and as continuations."""
    starts = np.array(model["starts"])

    def run(table):
        shard = table.column("shard")[0].as_py()
        a, b = _cat(table, "a", np.int64, True), _cat(table, "b", np.int64)
        key, first, back = np.unique(pair_key(a, b), return_index=True, return_inverse=True)
        n = np.bincount(back, _cat(table, "n", np.int64)).astype(np.int64)
        a, b = a[first], b[first]
        put(model["uri"], "pair", shard, key)
        put(model["uri"], "pair_n", shard, n.astype(np.float32))
        ctx, total, one, two, many = _sum_by(a, n, *(x.astype(np.int64) for x in (n == 1, n == 2, n > 2)))
        word, before = np.unique(b, return_counts=True)
        ids = np.union1d(ctx, word)
        vals = np.zeros((5, len(ids)), np.int64)
        vals[:4, np.searchsorted(ids, ctx)] = total, one, two, many
        vals[4, np.searchsorted(ids, word)] = before
        cut = np.searchsorted(ids, starts)
        rows = [(int(s), tx.pack(ids[cut[s]:cut[s + 1]], True), tx.pack(vals[:, cut[s]:cut[s + 1]].reshape(-1)), b"")
                for s in np.flatnonzero(np.diff(cut))]
        rows.append((-1, tx.pack(np.array(_spectrum(n), np.int64)), b"", b""))
        return pa.Table.from_batches([_batch(rows)])
    return run


#: Of each word, in the order of the word array: as a context its total and its followers seen once, twice,
#: more often; as a continuation the number of its contexts.
_STAT_ARRAYS = {"ctx_n": np.int64, "ctx_1": np.float32, "ctx_2": np.float32, "ctx_3": np.float32, "cont_n": np.int64}


def _store_stats(model):
    def run(table):
        shard = table.column("shard")[0].as_py()
        if shard < 0:
            total = np.sum([tx.unpack(v, np.int64) for v in table.column("a").to_pylist()], axis=0)
            return _stats(-1, 0, 0, 0, total)
        lo, hi = model["starts"][shard], model["starts"][shard + 1]
        vals = np.zeros((5, hi - lo), np.int64)
        for k, v in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            vals[:, tx.unpack(k, np.int64, True) - lo] += tx.unpack(v, np.int64).reshape(5, -1)
        for (name, kind), col in zip(_STAT_ARRAYS.items(), vals):
            put(model["uri"], name, shard, col.astype(kind))
        cont = vals[4]
        return _stats(shard, cont.sum(), (cont > 0).sum(), 0, _spectrum(cont))
    return run


def discounts(spectrum: list[int]) -> list[float]:
    """D1, D2, D3+ from the number of items seen once to four times (0.5 where they tell nothing)."""
    n1, n2, n3, n4 = spectrum
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(x, 0.05), k) for x, k in zip(d, (0.95, 1.9, 2.9))]


def train(texts: DataFrame, uri: str, shards: int) -> dict:
    """Count the model over a column of binary ``text`` into folder ``uri``; returns its few global numbers."""
    total = lambda rows, c: sum(r[c] for r in rows)
    words = texts.mapInArrow(_count_words(shards), _PART).groupBy("shard").applyInArrow(_store_words(uri), _STATS).collect()
    entries = {r["shard"]: r["entries"] for r in words}
    starts = [0]
    for s in range(shards):
        starts.append(starts[-1] + entries.get(s, 0))
    model = {"uri": uri, "shards": shards, "starts": starts, "tokens": total(words, "total"), "vocab": total(words, "kinds")}
    pairs = texts.mapInArrow(_count_pairs(model), _PART).groupBy("shard").applyInArrow(_store_pairs(model), _PART)
    stats = pairs.groupBy("shard").applyInArrow(_store_stats(model), _STATS).collect()
    names = ("n1", "n2", "n3", "n4")
    low = [r for r in stats if r["shard"] >= 0]
    low_n = [total(low, n) for n in names]
    return model | {"pair_kinds": total(low, "total"), "word_kinds": total(low, "kinds"), "low_n": low_n, "low": discounts(low_n),
                    "high": discounts([total([r for r in stats if r["shard"] < 0], n) for n in names])}


class Scorer:
    """log10 probabilities of tokens from a mapped model."""

    def __init__(self, model: dict):
        m = self.m = model
        deal = lambda h: tx.shard_of(h, m["shards"])
        self.words = Lookup(m["uri"], "word", {"word_n": np.int64, **_STAT_ARRAYS}, m["shards"], deal, m["starts"])
        self.pairs = Lookup(m["uri"], "pair", {"pair_n": np.float32}, m["shards"], deal)

    @staticmethod
    def _less(n: np.ndarray, d: list[float]) -> np.ndarray:
        return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)], 0.0)

    def __call__(self, tokens: np.ndarray, contexts: np.ndarray):
        """(count of each token, log10 of its smoothed frequency, log10 P(token | context))."""
        m = self.m
        uniform = 1.0 / (m["vocab"] + 1)
        both, t = np.unique(np.append(tokens, START), return_inverse=True)
        t, start = t[:-1], t[-1]
        # a context is the token before, or START
        h = np.where(contexts == START, start, np.roll(t, 1))
        known, w = self.words.find(both)
        w = {n: v if n == "id" else v.astype(np.float64) for n, v in w.items()}
        c = w["word_n"]
        base = np.log10((c + 0.1) / (m["tokens"] + 0.1 * (m["vocab"] + 1)))
        if not m["pair_kinds"]:
            return c[t], base[t], np.full(len(tokens), math.log10(uniform))
        n1, n2 = m["low_n"][:2]
        d = m["low"]
        left = (d[0] * n1 + d[1] * n2 + d[2] * (m["word_kinds"] - n1 - n2)) / m["pair_kinds"]
        low = self._less(w["cont_n"], d) / m["pair_kinds"] + left * uniform
        d = m["high"]
        total = w["ctx_n"]
        seen = total > 0
        total = np.maximum(total, 1)
        gamma = np.where(seen, (d[0] * w["ctx_1"] + d[1] * w["ctx_2"] + d[2] * w["ctx_3"]) / total, 1.0)
        n = np.zeros(len(tokens))
        at = np.flatnonzero(known[t] & known[h])
        n[at] = self.pairs.find(pair_key(w["id"][h[at]], w["id"][t[at]]))[1]["pair_n"]
        return c[t], base[t], np.log10(self._less(n, d) / total[h] + gamma[h] * low[t])


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(model):
    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for lo, hi, data, offsets in tx.text_chunks(batch):
                tokens, contexts, doc = token_stream(data, offsets)
                c, base, logp = scorer(tokens, contexts)
                n_docs = hi - lo
                n = np.bincount(doc, minlength=n_docs)
                add = lambda v: np.bincount(doc, v, minlength=n_docs)
                score = add(logp)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(lo, n_docs), "held_out": batch.column("held_out").slice(lo, n_docs),
                    "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(add(c > 0).astype(np.int64)),
                    "train_tokens": pa.array(np.full(n_docs, model["tokens"], np.int64)),
                    "base_score": pa.array(add(base)), "score": pa.array(score), "perplexity": pa.array(10 ** np.minimum(-score / n, 300))})
    return run


def lm_scores(docs: DataFrame, modulus: int = 10, remainder: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Scores of every row of ``docs``; the model learns from rows whose id hash is not ``remainder``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder).alias("held_out"), as_bytes())
    shards = shard_count(text_bytes(docs), shard_bytes)
    model = train(rows.filter(~F.col("held_out")).select("text"), scratch(docs.sparkSession, "kn-model"), shards)
    return rows.mapInArrow(_score(model), _OUT)


def op6_kn_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
