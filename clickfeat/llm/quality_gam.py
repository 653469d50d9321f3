"""Quality classifier: a generalised additive model with pairwise interactions.

Spark computes a row of text features per document (one pass over the texts). On a bounded labelled sample the
model is boosted in cycles: every round each feature in turn gets a shallow tree on its own bins, whose leaves are
added to that feature's lookup table; then the pairs with the most residual gain get small two-feature tables the
same way. Scoring is a sum of table entries by bin, vectorised over Arrow batches; no other work per document.

Inputs are features of the text alone. Odd input: a null or empty text has zero features and is scored like any
other; without labelled rows every score is 0.5; repeated rows each keep their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as tx, textstats as ts
from .common import as_bytes, documents, held_out, written
from .learning import SAMPLE_ROWS, labelled_sample, labels

CUTOFF = 0.7
BINS, PAIR_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, RIDGE = 32, 8, 120, 6, 60, 0.1, 2.0

_UPPER, _LETTER, _DIGIT, _HIGH, _PUNCT = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_HIGH[128:] = True
_PUNCT[list(b".,;:?\"'()-")] = True

FEATURES = ("log_words", "mean_word", "symbols", "pipes", "bangs", "upper", "digits", "high", "punct", "distinct",
            "log_top", "adjacent", "repeated", "log_lines", "dup_lines", "long_words")


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature matrix (documents x FEATURES) of a chunk."""
    w = tx.split_words(data, offsets)
    n_docs, n = len(offsets) - 1, w.counts
    per = np.maximum(n, 1).astype(np.float64)
    count = lambda table: ts.byte_sum(table[data], offsets)
    only = lambda ch: ts.byte_sum(data == ord(ch), offsets)
    chars = np.maximum(np.diff(offsets), 1)
    size = w.ends - w.starts
    earlier, _ = ts.repeats(w.hash, w.doc)
    key = w.hash + w.doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    order = np.argsort(key)
    s = key[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    top = np.zeros(n_docs)
    if len(start):
        np.maximum.at(top, w.doc[order[start]], np.diff(np.append(start, len(s))))
    same = np.zeros(len(w.hash), np.int64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    lines = only("\n") + 1
    cols = [np.log1p(n), tx.per_doc(size, w) / per, count(ts.SYMBOLS) / per, only("|") / per, only("!") / per,
            count(_UPPER) / np.maximum(count(_LETTER), 1), count(_DIGIT) / per, count(_HIGH) / chars, count(_PUNCT) / per,
            1 - np.bincount(w.doc[earlier], minlength=n_docs) / per, np.log1p(top), tx.per_doc(same, w) / per,
            ts.repeated_words(w, 8) / per, np.log(lines), ts.duplicate_lines(data, offsets) / lines,
            tx.per_doc((size > 14).astype(np.int64), w) / per]
    return np.stack(cols, 1)


def _feature_rows(batches):
    for batch in batches:
        for lo, hi, data, offsets in tx.text_chunks(batch):
            x = text_features(data, offsets)
            flat = pa.array(x.astype(np.float32).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * x.shape[1], pa.int32()), flat)
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo),
                                   "held_out": batch.column("held_out").slice(lo, hi - lo), "x": lists})


def _tree(g, h, lo, hi, depth):
    """Leaf value per bin of a small tree on ordered bins [lo, hi)."""
    leaf = lambda a, b: g[a:b].sum() / (h[a:b].sum() + RIDGE)
    if depth and hi - lo > 1:
        cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        tg, th = g[lo:hi].sum(), h[lo:hi].sum()
        gain = cg ** 2 / (ch + RIDGE) + (tg - cg) ** 2 / (th - ch + RIDGE) - tg ** 2 / (th + RIDGE)
        best = int(np.argmax(gain))
        if gain[best] > 1e-9:
            cut = lo + best + 1
            return _tree(g, h, lo, cut, depth - 1) + _tree(g, h, cut, hi, depth - 1)
    return [leaf(lo, hi)] * (hi - lo)


def _pair_tree(g, h):
    """Leaf value per cell: the best cut of one feature, then of the other on either side; and its gain."""
    best, table = 0.0, np.zeros(g.shape)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, a.shape[0]):
            cells, total = np.zeros(a.shape), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = a[part].sum(0), b[part].sum(0)
                values = np.array(_tree(pg, ph, 0, len(pg), 1))
                cells[part] = values
                total += float((pg * values).sum())
            if total > best:
                best, table = total, cells.T if flip else cells
    return table, best


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Boost lookup tables; returns base, edges, tables, pairs."""
    if not len(y):
        return {"base": 0.0, "edges": [], "tables": [], "pairs": []}
    rate = np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1))
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    small = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            p = _sigmoid(z)
            k = len(tables[f])
            step = RATE * np.array(_tree(np.bincount(b, y - p, k), np.bincount(b, p * (1 - p), k), 0, k, 2))
            tables[f] += step
            z += step[b]

    def grid(i, j, v):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(small[i] * shape[1] + small[j], v, shape[0] * shape[1]).reshape(shape)

    p = _sigmoid(z)
    gains = sorted(((_pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1], i, j)
                    for i in range(x.shape[1]) for j in range(i)), reverse=True)[:PAIRS]
    pairs = [[i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))] for _, i, j in gains]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            p = _sigmoid(z)
            step = RATE * _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0]
            table += step
            z += step[small[i], small[j]]
    return {"base": base, "edges": edges, "tables": tables, "coarse": coarse, "pairs": pairs}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of a feature matrix by table lookups."""
    z = np.full(len(x), model["base"])
    for f, (e, t) in enumerate(zip(model["edges"], model["tables"])):
        z += t[np.searchsorted(e, x[:, f], "right")]
    for i, j, t in model["pairs"]:
        z += t[np.searchsorted(model["coarse"][i], x[:, i], "right"), np.searchsorted(model["coarse"][j], x[:, j], "right")]
    return _sigmoid(z)


def _score_rows(model):
    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).astype(np.float64).reshape(-1, len(FEATURES))
            s = score(model, x)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(s),
                                   "predicted": pa.array((s >= CUTOFF).astype(np.int32))})
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; learns from at most ``sample_rows`` labels."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"), as_bytes())
    features = written(rows.mapInArrow(_feature_rows, "doc_id long, held_out boolean, x array<float>"), "gam-features")
    sample = labelled_sample(features, labels, label, sample_rows).select("doc_id", "x", "label").toPandas().sort_values("doc_id")
    x = np.array(sample["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    model = fit(x, sample["label"].to_numpy(np.float64))
    return features.mapInArrow(_score_rows(model), "doc_id long, held_out boolean, score double, predicted int")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))
