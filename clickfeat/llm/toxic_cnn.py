"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

* Words (lower-case letters and digits and all characters beyond ASCII) are embedded as the sum of three hashed
  vectors: of the word and of its first four and first six bytes. A cell of the table belongs to the training key
  that tells the classes apart most; other keys that fall on it are told by a signature and have no vector.
* Filters of widths 1 to 3 run over the words, are rectified and max-pooled over the whole text, and a logistic
  unit reads the pools. Only the words at the maxima get gradients, so training is cheap.
* Scoring multiplies the embedding table with every filter tap beforehand: a chunk is gathered, shifted, added and
  reduced per document.
* Thresholds are calibrated by language on a quarter of the labelled rows that a first model has not seen: the score that best
  splits a language's labels (languages with few labels are pooled). Then the model is fitted to all of them.
  The language never enters a score.

All labelled training rows are learnt from. They are dealt into shards of about ``SHARD_BYTES``; their keys are counted by an
aggregate; in every round each shard trains from the common model in its own task, and the shards' steps are averaged
(cell by cell over the shards that moved the cell). Thresholds come from exact counts by score of a grid. What fits one
shard trains in one task as it stands. Odd input: null and empty texts have empty pools and get the score of the bias;
without training rows of both classes the model rejects nothing (every score is next to 0); repeated rows each keep their row.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as tx
from ..operators.idfilter import rows_asked_for
from ..session import reliable_checkpoint
from .common import as_bytes, documents, fingerprint, held_out, shard_count, text_bytes, written
from .learning import known_labels, labelled_sample, labels
from .license_scan import WORD_BYTES

CUTOFF = 0.3
#: Bytes of text that one task trains on, about.
SHARD_BYTES = 12 << 20
#: Where there are several shards: rounds of averaging, and passes over a shard in each.
ROUNDS, SHARD_EPOCHS = 2, 2
#: Steps of the shards are added up as whole numbers of this unit, so that their order does not matter.
UNIT = 1.0 / (1 << 32)
#: Scores of the calibration are counted by the cells of a grid over the log odds.
GRID = 4096
TABLE_BITS, DIM, WIDTHS, FILTERS = 18, 6, (1, 2, 3), 4
#: Keys in fewer sample texts have no vector.
LEAST_DOCS = 4
EPOCHS, BATCH, BATCH_WORDS, RATE = 8, 64, 200_000, 0.1
#: Bytes of text scored at a time, about: a byte takes up to some 150 in between.
SCORE_BYTES = 1 << 18
#: Log odds of a unit that has learnt nothing: below any cutoff.
UNTRAINED = -30.0
PREFIXES = (4, 6)

_U = np.uint64
_TAPS = [(w, k) for w in WIDTHS for k in range(w)]


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of each word and its prefixes, row starts by document); two empty words end each text."""
    data = tx.LOWER[data]
    w = tx.split_words(data, offsets, WORD_BYTES)
    n_docs = len(offsets) - 1
    keys = np.zeros((len(w.starts) + 2 * n_docs, 1 + len(PREFIXES)), np.uint64)
    at = np.arange(len(w.starts)) + 2 * w.doc
    keys[at, 0] = w.hash
    for c, size in enumerate(PREFIXES, 1):
        long = w.ends - w.starts >= size
        h = tx.hash_spans(data, w.starts[long], w.starts[long] + size)
        keys[at[long], c] = h + _U(c)
    return keys, w.first + 2 * np.arange(n_docs + 1)


def rows_of(keys: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Table rows of keys; row 0 (no vector) where another key owns the cell."""
    cell = (keys & _U(len(signs) - 1)).astype(np.int64)
    return np.where((signs[cell] == (keys >> _U(32)).astype(np.uint32)) & (keys != 0), cell, 0)


def pooled(token_taps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter outputs at every position and their maxima by document (texts end in two empty words)."""
    n = len(token_taps)
    out = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    c = 0
    for i, width in enumerate(WIDTHS):
        part = np.zeros((n, FILTERS), np.float32)
        for k in range(width):
            part[:n - k] += token_taps[k:, c:c + FILTERS]
            c += FILTERS
        out[:, i * FILTERS:(i + 1) * FILTERS] = part
    pads = np.concatenate([starts[1:] - 1, starts[1:] - 2])
    out[pads] = -np.inf
    return out, np.maximum.reduceat(out, starts[:-1], axis=0)


def _runs(sizes, most: int, count: int):
    """(first, end) of runs of at most ``count`` items and about ``most`` in sum (or one larger item)."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (held + n > most or i - lo == count):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _chunks(texts: list[bytes]):
    """(first text, keys, row starts) of some texts at a time."""
    for lo, hi in _runs([len(t) for t in texts], tx.CHUNK_BYTES // 2, 512):
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])])
        yield lo, *word_keys(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), offsets)


def _counted(keys: np.ndarray, starts: np.ndarray, y: np.ndarray):
    """Distinct keys of a chunk of texts, the texts that hold each, and the toxic ones of those."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    keys, doc = keys.ravel(), np.repeat(doc, keys.shape[1])
    doc, keys = doc[keys != 0], keys[keys != 0]
    u, code = np.unique(keys, return_inverse=True)
    pairs = np.unique(code.astype(np.int64) * len(y) + doc)
    code, doc = np.divmod(pairs, len(y))
    return u, np.bincount(code, minlength=len(u)), np.bincount(code, y[doc], minlength=len(u))


def _key_counts(texts: list[bytes], y: np.ndarray):
    """Distinct keys, the texts that hold each, and the toxic ones of those. Counted chunk by chunk: memory follows the distinct keys."""
    u, df, toxic = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for lo, keys, starts in _chunks(texts):
        more, n, bad = _counted(keys, starts, y[lo:lo + len(starts) - 1])
        both = np.union1d(u, more)
        counts = np.zeros((2, len(both)))
        for k, a, b in ((u, df, toxic), (more, n, bad)):
            at = np.searchsorted(both, k)
            counts[0, at] += a
            counts[1, at] += b
        u, (df, toxic) = both, counts
    return u, df, toxic


def _owners(u: np.ndarray, df: np.ndarray, toxic: np.ndarray, pos: float, neg: float):
    """Signature per table cell and the shrunk log odds of its owner."""
    kept = df >= LEAST_DOCS
    u, df, toxic = u[kept], df[kept], toxic[kept]
    pos, neg = max(pos, 1), max(neg, 1)
    odds = np.log((toxic + 0.5 * pos / (pos + neg)) / pos) - np.log((df - toxic + 0.5 * neg / (pos + neg)) / neg)
    odds *= df / (df + 8.0)
    size = 1 << TABLE_BITS
    order = np.argsort(np.abs(odds) * np.sqrt(df), kind="stable")  # the most telling key of a cell is written last
    cell = (u & _U(size - 1)).astype(np.int64)[order]
    signs, lean = np.zeros(size, np.uint32), np.zeros(size, np.float32)
    signs[cell] = (u >> _U(32)).astype(np.uint32)[order]
    lean[cell] = odds[order]
    lean[0] = 0
    return signs, np.clip(lean, -4, 4)


def _untrained(seed: int = 7) -> tuple[dict, np.random.Generator]:
    """A model that has learnt nothing, and the generator that goes on from there."""
    rng = np.random.default_rng(seed)
    size = 1 << TABLE_BITS
    taps = [rng.normal(0, 0.1, (DIM, FILTERS)).astype(np.float32) for _ in _TAPS]
    for (width, _), t in zip(_TAPS, taps):
        t[0] = np.linspace(0.5, 1.0, FILTERS) / width
    out = np.full(len(WIDTHS) * FILTERS, 0.4, np.float32)
    bias = np.full(len(WIDTHS) * FILTERS, -0.5, np.float32)
    model = {"signs": np.zeros(size, np.uint32), "embed": np.zeros((size, DIM), np.float32), "taps": taps, "bias": bias, "out": out, "last": UNTRAINED}
    return model, rng


def _started(signs: np.ndarray, lean: np.ndarray, rate: float, model: dict, rng: np.random.Generator) -> dict:
    """The model before its first step: vectors lean as the counts do."""
    embed = rng.normal(0, 0.01, (len(signs), DIM)).astype(np.float32)
    embed[:, 0] = lean / 2
    embed[0] = 0
    rate = np.clip(rate, 0.01, 0.99)
    return {**model, "signs": signs, "embed": embed, "last": float(np.log(rate / (1 - rate))) - 1.0}


def fit(texts: list[bytes], y: np.ndarray, seed: int = 7) -> dict:
    model, rng = _untrained(seed)
    if not len(texts) or y.min() == y.max():
        return model
    signs, lean = _owners(*_key_counts(texts, y), y.sum(), (1 - y).sum())
    return descend(_started(signs, lean, y.mean(), model, rng), texts, y, rng, EPOCHS)


def descend(model: dict, texts: list[bytes], y: np.ndarray, rng: np.random.Generator, epochs: int) -> dict:
    """``model`` (changed in place) after so many passes over the texts."""
    signs, embed, taps, bias, out, last = (model[k] for k in ("signs", "embed", "taps", "bias", "out", "last"))
    parts, starts = [], [0]
    for _, keys, s in _chunks(texts):
        parts.append(rows_of(keys, signs).astype(np.int32))
        starts.extend((s[1:] + starts[-1]).tolist())
    rows, starts = np.concatenate(parts), np.array(starts)
    del parts, keys
    sq = {id(a): np.full(a.shape, 1e-2, np.float32) for a in (*taps, bias, out, embed)}
    sq_last = 1e-2

    def step(a, g, where=...):
        s = sq[id(a)]
        s[where] += g * g
        a[where] -= RATE * g / np.sqrt(s[where])

    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo, hi in _runs(np.diff(starts)[order].tolist(), BATCH_WORDS, BATCH):
            docs = order[lo:hi]
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
            cuts = np.concatenate([[0], np.cumsum(starts[docs + 1] - starts[docs])])
            r = rows[at]
            x = embed[r].sum(1)
            pre, best = pooled(np.concatenate([x @ t for t in taps], 1), cuts)
            best = np.where(np.isfinite(best), best, -1e3) + bias
            pool = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-np.clip(pool @ out + last, -30, 30)))
            dz = ((p - y[docs]) / len(docs)).astype(np.float32)
            dpre = dz[:, None] * out * (pool > 0)
            step(out, pool.T @ dz)
            step(bias, dpre.sum(0))
            sq_last += dz.sum() ** 2
            last -= RATE * float(dz.sum()) / np.sqrt(sq_last)
            grads = [np.zeros_like(t) for t in taps]
            touched, delta = [], []
            for d, f in zip(*np.nonzero(dpre)):
                i, ff = divmod(f, FILTERS)
                top = cuts[d] + int(np.argmax(pre[cuts[d]:cuts[d + 1], f]))
                tap0 = sum(WIDTHS[:i])
                for k in range(WIDTHS[i]):
                    grads[tap0 + k][:, ff] += x[top + k] * dpre[d, f]
                    for cell in r[top + k]:
                        if cell:
                            touched.append(cell)
                            delta.append(taps[tap0 + k][:, ff] * dpre[d, f])
            for t, g in zip(taps, grads):
                step(t, g)
            if touched:
                cells, back = np.unique(touched, return_inverse=True)
                g = np.zeros((len(cells), DIM), np.float32)
                np.add.at(g, back, np.array(delta, np.float32))
                step(embed, g, cells)
    return {"signs": signs, "embed": embed, "taps": taps, "bias": bias, "out": out, "last": last}


class Scorer:
    def __init__(self, model: dict):
        self.m = model
        self.table = np.concatenate([model["embed"] @ t for t in model["taps"]], 1).astype(np.float32)
        self.table[0] = 0

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        keys, starts = word_keys(data, offsets)
        r = rows_of(keys, self.m["signs"])
        some = np.flatnonzero(r.any(1))
        taps = np.zeros((len(r), self.table.shape[1]), np.float32)
        taps[some] = self.table[r[some]].sum(1)
        _, best = pooled(taps, starts)
        pool = np.maximum(np.where(np.isfinite(best), best, -1e3) + self.m["bias"], 0)
        return 1 / (1 + np.exp(-np.clip((pool @ self.m["out"]).astype(np.float64) + self.m["last"], -30, 30)))


def threshold(scores: np.ndarray, y: np.ndarray, least: int, n: np.ndarray | None = None) -> float | None:
    """The middle of the widest run of cutoffs with the fewest errors, both classes weighing the same (None: too few rows).
    Row ``i`` stands for ``n[i]`` rows."""
    n = np.ones(len(y)) if n is None else n
    if n[y == 1].sum() < least or n[y == 0].sum() < least:
        return None
    cuts = np.unique(np.concatenate([[0.0], scores, [1.0]]))
    mid = (cuts[1:] + cuts[:-1]) / 2
    below = []
    for cls in (1, 0):
        order = np.argsort(scores[y == cls], kind="stable")
        upto = np.concatenate([[0.0], np.cumsum(n[y == cls][order])])
        below.append(upto[np.searchsorted(scores[y == cls][order], mid)] / upto[-1])
    errors = below[0] + (1 - below[1])
    ok = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(mid[ok[np.argmax((cuts[1:] - cuts[:-1])[ok])]])


def calibrate(scores: np.ndarray, y: np.ndarray, langs: list, cutoff: float = CUTOFF, least: int = 20,
              n: np.ndarray | None = None) -> tuple[dict, float]:
    """Threshold by language, and the one of all others: languages with fewer than ``least`` rows of a class are pooled, a
    pool that is still too small is calibrated on all rows, and if these are too few it has the common cutoff."""
    n = np.ones(len(y)) if n is None else n
    out, pool = {}, np.ones(len(y), bool)
    for lang in sorted({x for x in langs if x is not None}):
        m = np.array([x == lang for x in langs])
        t = threshold(scores[m], y[m], least, n[m])
        if t is not None:
            out[lang] = t
            pool &= ~m
    found = [threshold(scores[m], y[m], least, n[m]) for m in (pool, np.ones(len(y), bool))]
    return out, next((t for t in found if t is not None), cutoff)


def _score_rows(model):
    def run(batches):
        scorer = Scorer(_unpacked(model if isinstance(model, bytes) else model.value))
        for batch in batches:
            for lo, hi, data, offsets in tx.text_chunks(batch, limit=SCORE_BYTES):
                s = scorer(data, offsets)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "held_out": batch.column("held_out").slice(lo, hi - lo),
                                       "lang": batch.column("lang").slice(lo, hi - lo), "print": batch.column("print").slice(lo, hi - lo),
                                       "score": pa.array(s)})
    return run


def _trained(texts: list[bytes], y: np.ndarray, langs: list) -> dict:
    """Thresholds from the last quarter of the texts under a model of the others; then a model of all of them."""
    pick = np.random.default_rng(3).permutation(len(texts))
    cut = len(texts) * 3 // 4
    model = fit([texts[i] for i in pick[:cut]], y[pick[:cut]])
    scorer = Scorer(model)
    rest = [int(i) for i in pick[cut:]]
    scores = np.array([float(scorer(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))[0]) for i in rest])
    by_lang, other = calibrate(scores, y[rest], [langs[i] for i in rest])
    del scorer, model
    last = fit(texts, y)
    return {"model": _packed(last), "learnt": last["last"] > UNTRAINED, "thresholds": by_lang, "threshold": other, "n_texts": len(texts)}


def _train_task(batches):
    """The whole (bounded) sample in one task: one row with the packed model and the thresholds."""
    rows = [(i, t, g, y) for batch in batches for i, t, g, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "label")))]
    if not rows:
        return
    rows.sort(key=lambda r: r[:2])
    texts, langs, y = [r[1] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows])
    del rows
    pa.default_memory_pool().release_unused()
    yield pa.record_batch({"trained": pa.array([pickle.dumps(_trained(texts, y, langs))], pa.binary())})


def _count_task(batches):
    """(key, texts that hold it, toxic ones of those), of all training rows and of those that do not calibrate."""
    for batch in batches:
        texts, y, part = (batch.column(c).to_pylist() for c in ("text", "label", "part"))
        y, learns = np.array(y), np.array(part) != 0
        for lo, keys, starts in _chunks(texts):
            hi = lo + len(starts) - 1
            u, n, bad = _counted(keys, starts, y[lo:hi])
            mine = learns[lo:hi]
            held = np.zeros((2, len(u)))
            if mine.any():
                some = np.repeat(mine, np.diff(starts))
                at = np.concatenate([[0], np.cumsum(np.diff(starts)[mine])])
                v, n3, bad3 = _counted(keys[some], at, y[lo:hi][mine])
                held[:, np.searchsorted(u, v)] = n3, bad3
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (u.view(np.int64), n, bad, *held)], names=["key", "n", "bad", "n3", "bad3"])


def _owner_task(pos: float, neg: float):
    """The owners of the table's cells (one task: at most a row per cell comes out of the aggregate before it)."""
    def run(batches):
        got = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "bad")] for b in batches]
        u, n, bad = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
        order = np.argsort(u.view(np.uint64))
        model, rng = _untrained()
        signs, lean = _owners(u.view(np.uint64)[order], n[order].astype(float), bad[order].astype(float), pos, neg)
        yield pa.record_batch({"model": pa.array([_packed(_started(signs, lean, pos / (pos + neg), model, rng))], pa.binary())})
    return run


def _packed(model: dict) -> bytes:
    """A model on its way; cells without an owner have no vector that a text could ask for."""
    model["embed"][model["signs"] == 0] = 0
    return zlib.compress(pickle.dumps(model), 1)


def _unpacked(model: bytes) -> dict:
    return pickle.loads(zlib.decompress(model))


def _flat(model: dict) -> np.ndarray:
    return np.concatenate([*(t.ravel() for t in model["taps"]), model["bias"], model["out"], [model["last"]]]).astype(np.float64)


def _step_task(model, epochs: int):
    """One shard's steps from the common model: (cell, moves as whole units); numbers beyond the table are the shared weights."""
    def run(batches):
        rows = sorted((i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label"))))
        if not rows:
            return
        first, last = _unpacked(model.value), _unpacked(model.value)
        descend(last, [r[1] for r in rows], np.array([r[2] for r in rows]), np.random.default_rng(len(rows)), epochs)
        moved = np.flatnonzero((last["embed"] != first["embed"]).any(1))
        flat = _flat(last) - _flat(first)
        size = len(first["signs"])
        move = np.zeros((len(moved) + len(flat), DIM))
        move[:len(moved)] = last["embed"][moved].astype(np.float64) - first["embed"][moved]
        move[len(moved):, 0] = flat
        cells = np.concatenate([moved, size + np.arange(len(flat))])
        units = np.rint(move / UNIT).astype(np.int64)
        yield pa.record_batch([pa.array(cells.astype(np.int32))] + [pa.array(units[:, d]) for d in range(DIM)], names=["cell"] + [f"m{d}" for d in range(DIM)])
    return run


def _merge_task(model):
    """The common model after the averaged steps (one task: at most a row per cell)."""
    def run(batches):
        m = _unpacked(model.value)
        flat, size = _flat(m), len(m["signs"])
        for b in batches:
            cell = b.column("cell").to_numpy()
            n = b.column("n").to_numpy()
            move = np.stack([b.column(f"m{d}").to_numpy() for d in range(DIM)], 1) * UNIT / n[:, None]
            own = cell < size
            m["embed"][cell[own]] += move[own].astype(np.float32)
            flat[cell[~own] - size] += move[~own, 0]
        at = 0
        for a in (*m["taps"], m["bias"], m["out"]):
            a[...] = flat[at:at + a.size].reshape(a.shape)
            at += a.size
        m["last"] = float(flat[at])
        yield pa.record_batch({"model": pa.array([_packed(m)], pa.binary())})
    return run


def _fit_shards(rows: DataFrame, counts: DataFrame, n: str, bad: str, pos: int, neg: int) -> bytes:
    """The packed model of all ``rows`` (a partition per shard); ``counts`` are those of their keys."""
    if not pos or not neg:
        return _packed(_untrained()[0])
    c = counts.select("key", F.col(n).alias("n"), F.col(bad).alias("bad")).filter(F.col("n") >= LEAST_DOCS)
    # of the keys of a cell only the most telling one matters
    share = pos / (pos + neg)
    odds = F.log((F.col("bad") + 0.5 * share) / pos) - F.log((F.col("n") - F.col("bad") + 0.5 * (1 - share)) / neg)
    telling = F.abs(odds * F.col("n") / (F.col("n") + 8.0)) * F.sqrt("n")
    cell = F.col("key").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    best = c.groupBy(cell.alias("cell")).agg(F.max_by(F.struct("key", "n", "bad"), F.struct(F.round(telling, 9), "key")).alias("b")).select("b.*")
    model = best.coalesce(1).mapInArrow(_owner_task(pos, neg), "model binary").first()
    if model is None:  # no key is in enough texts: the shards start from none
        m, rng = _untrained()
        none = np.zeros(1 << TABLE_BITS)
        model = {"model": _packed(_started(none.astype(np.uint32), none, share, m, rng))}
    model = model["model"]
    moves = "cell int, " + ", ".join(f"m{d} long" for d in range(DIM))
    for _ in range(ROUNDS):
        common = rows.sparkSession.sparkContext.broadcast(model)
        steps = rows.select("doc_id", "text", "label").mapInArrow(_step_task(common, SHARD_EPOCHS), moves)
        mean = steps.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"m{d}").alias(f"m{d}") for d in range(DIM)])
        model = mean.coalesce(1).mapInArrow(_merge_task(common), "model binary").first()["model"]
        common.destroy()  # the driver holds one round's model
    return model


def _calibrated(rows: DataFrame, model: bytes) -> tuple[dict, float]:
    """Thresholds from all rows of the quarter that ``model`` has not seen: counted by language, label and cell of a grid over
    the log odds, so that the driver holds a bounded table whatever their number."""
    held = rows.filter("part = 0").select("doc_id", F.lit(True).alias("held_out"), "lang", F.col("label").cast("long").alias("print"), "text")
    common = rows.sparkSession.sparkContext.broadcast(model)
    scored = held.mapInArrow(_score_rows(common), "doc_id long, held_out boolean, lang string, print long, score double")
    odds = F.log(F.greatest("score", F.lit(1e-13)) / F.greatest(1 - F.col("score"), F.lit(1e-13)))
    at = F.floor((odds + 30) / 60 * GRID).cast("int")
    by = scored.groupBy("lang", F.col("print").alias("label"), at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))
    found = by.orderBy("lang", "label", "at").collect()  # two labels and GRID cells a language at most
    common.destroy()
    return calibrate(np.array([r["score"] for r in found]), np.array([float(r["label"]) for r in found]), [r["lang"] for r in found],
                     n=np.array([float(r["n"]) for r in found]))


def _trained_in_shards(rows: DataFrame) -> dict:
    """As :func:`_trained`, on rows in a partition per shard."""
    counts = reliable_checkpoint(rows.mapInArrow(_count_task, "key long, n long, bad long, n3 long, bad3 long").groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("n", "bad", "n3", "bad3")]).filter(F.col("n") >= LEAST_DOCS))
    learns = F.col("part") != 0
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"), F.sum(learns.cast("int")).alias("n3"),
                 F.sum(F.when(learns, F.col("label")).otherwise(0)).alias("pos3")).first()
    model = _fit_shards(rows.filter(learns), counts, "n3", "bad3", int(n["pos3"]), int(n["n3"] - n["pos3"]))
    by_lang, other = _calibrated(rows, model)
    last = _fit_shards(rows, counts, "n", "bad", int(n["pos"]), int(n["n"] - n["pos"]))  # stays packed on the driver
    return {"model": last, "learnt": 0 < n["pos"] < n["n"], "thresholds": by_lang, "threshold": other, "n_texts": n["n"]}


def _train_alone(rows: DataFrame) -> dict:
    """Trained on rows that fit one task."""
    found = rows.coalesce(1).mapInArrow(_train_task, "trained binary").first()
    return pickle.loads(found["trained"]) if found else _trained([], np.zeros(0), [])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int | None = None,
          sample_bytes: int | None = None) -> dict:
    """Model and thresholds from all labelled training rows of ``docs``; a caller may bound them (:func:`_bounded`).

    Rows with equal id and text train once. The driver holds the model alone (some MB).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), as_bytes())
    if sample_rows is not None or sample_bytes is not None:
        return _train_alone(_bounded(rows, labels, label, sample_rows, sample_bytes))
    known = reliable_checkpoint(known_labels(labels, label))
    asked = rows_asked_for(rows.filter(F.col("doc_id").isNotNull()), "doc_id", known)
    shards = shard_count(text_bytes(asked), SHARD_BYTES, 1)
    # dealt once by id: the join, the removal of repeats and every round use the same partitions
    got = asked.repartition(shards, "doc_id").join(known.repartition(shards, "doc_id").hint("merge"), "doc_id")
    got = got.withColumn("print", F.xxhash64("text")).dropDuplicates(["doc_id", "print"]).select(
        "doc_id", "text", "lang", F.col("label").cast("double"), F.pmod(F.xxhash64("doc_id", "print", F.lit(3)), F.lit(4)).alias("part"))
    return _train_alone(got) if shards == 1 else _trained_in_shards(reliable_checkpoint(got))


def _bounded(rows: DataFrame, labels: DataFrame, label: str, sample_rows: int | None, sample_bytes: int | None) -> DataFrame:
    """At most ``sample_rows`` labelled rows by id hash, each that fits what is left of ``sample_bytes``."""
    sample_rows = (1 << 31) - 1 if sample_rows is None else sample_rows
    sample = written(labelled_sample(rows, labels, label, sample_rows).withColumns(
        {"size": F.octet_length("text"), "print": F.xxhash64("text")}), "toxic-sample")
    row = ["doc_id", "print"]
    # at most sample_rows rows of three numbers
    left = (1 << 62) if sample_bytes is None else sample_bytes
    sizes = sample.filter(F.col("size") <= left).select(*row, "size").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id", "size", "print").limit(sample_rows).collect()
    fits = []
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            fits.append((r["doc_id"], r["print"]))
    chosen = rows.sparkSession.createDataFrame(fits, "doc_id long, print long")
    return sample.join(F.broadcast(chosen), row).dropDuplicates(row).select("doc_id", "text", "lang", F.col("label").cast("double"))


def verdicts(docs: DataFrame, labels: DataFrame, label: str = "toxic", cutoff: float = CUTOFF) -> DataFrame:
    """The columns of :func:`toxicity` and ``print``, the fingerprint of the text (see :func:`.common.fingerprint`)."""
    trained = train(docs, labels, label)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"),
                       F.col("lang").cast("string").alias("lang"), fingerprint().alias("print"), as_bytes())
    scored = rows.mapInArrow(_score_rows(trained["model"]), "doc_id long, held_out boolean, lang string, print long, score double")
    limit = F.lit(trained["threshold"])
    for lang, t in trained["thresholds"].items():
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "lang",
                         limit.alias("threshold"), (F.col("score") >= limit).alias("flagged"), "print")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted (common cutoff), threshold and flagged (by language) of every row of ``docs``."""
    return verdicts(docs, labels, label, cutoff).drop("print")


def op3_toxic_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
