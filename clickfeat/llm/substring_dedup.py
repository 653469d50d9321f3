"""Exact substring deduplication by fixed-block anchors.

A word is removed when a window of ``window`` words that covers it also starts in a
document with a smaller id. Blocks of ``(window + 1) // 2`` words at multiples of the
block length are the index: any window that repeats contains one whole block of the
other copy, so probing the index with every rolling block finds all repeats.

1. *Index and probe.* Every rolling block is sent to the hash shard it belongs to,
   flagged when it stands on the block grid (those entries are the index). A block is
   an anchor hit when it occurs at least twice and once on the grid. Repeats inside a
   chunk of documents are collapsed before the shuffle, so a passage in a third of all
   documents arrives as one entry per chunk.
2. *Extend.* Around each hit all windows that contain it are hashed whole and resolved
   to the smallest document id that holds them; overlapping removed windows merge into
   maximal repeats.
3. *Remove.* The texts meet their removed windows by (id, text fingerprint).

Every shard has a size fixed by the total bytes; nothing is collected. Results for odd
input: null text counts as no words; a null id sorts after all ids and never causes a
removal; repeated ids are one document (neither removes from the other); repeated rows
each keep their row.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as tx
from .common import as_bytes, documents, shard_count, text_bytes

WINDOW = 13
#: Text bytes per hash shard of step 1 and 2: about four million blocks.
SHARD_BYTES = 24 << 20

_U = np.uint64
_PART = "shard long, flush long, kind int, pos binary, val binary, ids binary, fps binary, first binary"
_PART_ARROW = pa.schema([("shard", pa.int64()), ("flush", pa.int64()), ("kind", pa.int32())]
                        + [(c, pa.binary()) for c in ("pos", "val", "ids", "fps", "first")])
_DOC = "doc_id long, fp long, at binary"
_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("at", pa.binary())])


def _flush_id(ids: np.ndarray, fps: np.ndarray) -> int:
    """An id of a chunk that follows from its rows, so a task that runs again gives the same."""
    raw = hashlib.blake2b(ids.tobytes() + fps.tobytes(), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)


def _first_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values' first index, index of every repeat, its first index)."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    heads = order[new]
    head_of = heads[np.cumsum(new) - 1] if len(s) else heads
    return heads, order[~new], head_of[~new]


def _rows(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PART_ARROW.types)], schema=_PART_ARROW)


def _spread(flush, pos, keys, val, extra, table, shards):
    """Payload rows of one chunk, one per shard, and its table row (documents, repeats)."""
    sh = tx.shard_of(keys, shards)
    order = np.lexsort((pos, sh))
    bounds = np.searchsorted(sh[order], np.arange(shards + 1))
    rows = []
    for k in np.flatnonzero(np.diff(bounds)):
        o = order[bounds[k]:bounds[k + 1]]
        rows.append((int(k), flush, 0, tx.pack(pos[o].astype(np.uint32), True), tx.pack(val[o]),
                     tx.pack(extra[o]) if extra is not None else b"", b"", b""))
    rows.append((int(_U(flush & 0x7FFFFFFF) % _U(shards)), flush, 1, *table))
    return _rows(rows)


def _probes(block: int, shards: int):
    def run(batches):
        for batch in batches:
            ids, fps = tx.ids_of(batch.column("doc_id")), tx.ids_of(batch.column("fp"))
            for lo, hi, data, offsets in tx.text_chunks(batch, limit=2 * tx.CHUNK_BYTES):
                w = tx.split_words(data, offsets)
                pos, g = tx.grams(w, block)
                if not len(pos):
                    continue
                grid = (pos - w.first[w.doc[pos]]) % block == 0
                heads, again, head = _first_of(g)
                flags = grid.astype(np.uint32)
                np.bitwise_or.at(flags, head, flags[again] | np.uint32(2))
                val = ((g[heads] & _U(0x3FFFFFFF)).astype(np.uint32) << np.uint32(2)) | flags[heads]
                table = (tx.pack(pos[again].astype(np.uint32)), tx.pack(pos[head].astype(np.uint32)),
                         tx.pack(ids[lo:hi]), tx.pack(fps[lo:hi]), tx.pack(w.first.astype(np.uint32), True))
                yield _spread(_flush_id(ids[lo:hi], fps[lo:hi]), pos[heads], g[heads], val, None, table, shards)
    return run


def _parts(table: pa.Table):
    """(payload rows, table rows) of a group."""
    kind = np.asarray(table.column("kind"))
    return table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))


def _active(table: pa.Table) -> pa.Table:
    """Step 1 in a shard: positions whose block occurs twice and once on the grid."""
    pay, tables = _parts(table)
    vals = [tx.unpack(v, np.uint32) for v in pay.column("val").to_pylist()]
    out = [tables]
    if vals:
        v = np.sort(np.concatenate(vals))
        key = v >> 2
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        flags = np.bitwise_or.reduceat(v & 3, start)
        many = np.diff(np.append(start, len(v))) > 1
        hit = key[start][((flags & 1) > 0) & (many | ((flags & 2) > 0))]
        rows = []
        for flush, p, x in zip(pay.column("flush").to_pylist(), pay.column("pos").to_pylist(), vals):
            k = x >> 2
            at = np.searchsorted(hit, k)
            ok = (at < len(hit)) & (hit[np.minimum(at, len(hit) - 1)] == k) if len(hit) else np.zeros(len(k), bool)
            if ok.any():
                rows.append((0, flush, 0, tx.pack(tx.unpack(p, np.uint32, True)[ok], True), b"", b"", b"", b""))
        if rows:
            out.append(pa.Table.from_batches([_rows(rows)]))
    return pa.concat_tables(out).cast(_PART_ARROW)


def _docs_at(row: dict, pos: np.ndarray) -> pa.Table:
    """Positions of a chunk as one row per document that has any."""
    first = tx.unpack(row["first"], np.uint32, True).astype(np.int64)
    ids, fps = tx.unpack(row["ids"], np.int64), tx.unpack(row["fps"], np.int64)
    pos = np.unique(pos.astype(np.int64))
    doc = np.searchsorted(first, pos, "right") - 1
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    at = [tx.pack((p - first[d]).astype(np.uint32), True)
          for d, p in zip(doc[cut], np.split(pos, cut[1:]))] if len(cut) else []
    return pa.Table.from_arrays([pa.array(ids[doc[cut]], pa.int64()), pa.array(fps[doc[cut]], pa.int64()),
                                 pa.array(at, pa.binary())], schema=_DOC_ARROW)


def _hits(table: pa.Table) -> pa.Table:
    """Anchor hits of one chunk, by document."""
    pay, tables = _parts(table)
    if not tables.num_rows or not pay.num_rows:
        return _DOC_ARROW.empty_table()
    row = tables.slice(0, 1).to_pylist()[0]
    pos = np.unique(np.concatenate([tx.unpack(p, np.uint32, True) for p in pay.column("pos").to_pylist()]))
    again, head = tx.unpack(row["pos"], np.uint32), tx.unpack(row["val"], np.uint32)
    return _docs_at(row, np.concatenate([pos, again[np.isin(head, pos)]]))


def _windows(window: int, block: int, shards: int):
    """Step 2: every window that contains a hit, with its document."""
    def run(batches):
        for batch in batches:
            ids, fps = tx.ids_of(batch.column("doc_id")), tx.ids_of(batch.column("fp"))
            for lo, hi, data, offsets in tx.text_chunks(batch):
                w = tx.split_words(data, offsets)
                pos, g = tx.grams(w, window)
                if not len(pos):
                    continue
                mark = np.zeros(len(w.starts) + 1, np.int64)
                for d, raw in enumerate(batch.column("at").slice(lo, hi - lo).to_pylist()):
                    if raw:
                        at = tx.unpack(raw, np.uint32, True).astype(np.int64) + w.first[d]
                        mark[at] = 1
                seen = np.cumsum(mark)
                reach = window - block + 1  # starts of the blocks inside a window
                ok = seen[pos + reach - 1] - np.where(pos > 0, seen[pos - 1], 0) > 0
                pos, g = pos[ok], g[ok]
                if not len(pos):
                    continue
                own = ids[lo:hi][w.doc[pos]]
                heads, again, head = _first_of(g)
                np.minimum.at(own, head, own[again])
                table = (tx.pack(pos[again].astype(np.uint32)), tx.pack(pos[head].astype(np.uint32)),
                         tx.pack(ids[lo:hi]), tx.pack(fps[lo:hi]), tx.pack(w.first.astype(np.uint32), True))
                yield _spread(_flush_id(ids[lo:hi], fps[lo:hi]), pos[heads], g[heads], g[heads], own[heads], table, shards)
    return run


def _smallest(table: pa.Table) -> pa.Table:
    """Step 2 in a shard: the smallest id of each window, for the chunks that have a larger one."""
    pay, tables = _parts(table)
    vals = [tx.unpack(v, np.uint64) for v in pay.column("val").to_pylist()]
    out = [tables]
    if vals:
        owns = [tx.unpack(v, np.int64) for v in pay.column("ids").to_pylist()]
        g, own = np.concatenate(vals), np.concatenate(owns)
        order = np.argsort(g)
        s = g[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        least = np.minimum.reduceat(own[order], start)
        keys = s[start]
        rows = []
        for flush, p, x, o in zip(pay.column("flush").to_pylist(), pay.column("pos").to_pylist(), vals, owns):
            m = least[np.searchsorted(keys, x)]
            ok = m < o
            if ok.any():
                rows.append((0, flush, 0, tx.pack(tx.unpack(p, np.uint32, True)[ok], True), b"", tx.pack(m[ok]), b"", b""))
        if rows:
            out.append(pa.Table.from_batches([_rows(rows)]))
    return pa.concat_tables(out).cast(_PART_ARROW)


def _removed(table: pa.Table) -> pa.Table:
    """Removed windows of one chunk, by document."""
    pay, tables = _parts(table)
    if not tables.num_rows:
        return _DOC_ARROW.empty_table()
    row = tables.slice(0, 1).to_pylist()[0]
    first = tx.unpack(row["first"], np.uint32, True).astype(np.int64)
    ids = tx.unpack(row["ids"], np.int64)
    owner = lambda p: ids[np.searchsorted(first, p.astype(np.int64), "right") - 1]
    again, head = tx.unpack(row["pos"], np.uint32), tx.unpack(row["val"], np.uint32)
    at = [tx.unpack(p, np.uint32, True) for p in pay.column("pos").to_pylist()]
    least = [tx.unpack(p, np.int64) for p in pay.column("ids").to_pylist()]
    # smallest id per first occurrence: of the chunk, then of the shards' answers
    heads = np.unique(np.concatenate([head, *at])) if len(at) or len(head) else head
    if not len(heads):
        return _DOC_ARROW.empty_table()
    m = owner(heads)
    np.minimum.at(m, np.searchsorted(heads, head), owner(again))
    for p, x in zip(at, least):
        np.minimum.at(m, np.searchsorted(heads, p), x)
    gone = [heads[owner(heads) > m], again[owner(again) > m[np.searchsorted(heads, head)]]]
    return _docs_at(row, np.concatenate(gone))


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _remove(window: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches):
        for batch in batches:
            texts, ats = batch.column("text"), batch.column("at")
            n_words, n_gone, shas, kept_texts = [], [], [], []
            for text, at in zip(texts, ats):
                words = text.as_py().split()
                gone = 0
                if at.is_valid:
                    mask = tx.covered(tx.unpack(at.as_py(), np.uint32, True).astype(np.int64), window, len(words))
                    gone = int(mask.sum())
                    kept = b" ".join(compress(words, (~mask).tolist()))
                else:
                    kept = b" ".join(words)
                n_words.append(len(words))
                n_gone.append(gone)
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "replace") if with_text else None)
            ids = tx.ids_of(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=ids == tx.NULL_ID), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()),
                 pa.array(shas, pa.string()), pa.array(kept_texts, pa.string())], schema=schema)
    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
                            with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and (``with_text``) the kept words."""
    block = (window + 1) // 2
    shards = shard_count(text_bytes(docs), shard_bytes)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(tx.NULL_ID)).alias("doc_id"),
                       F.xxhash64(as_bytes()).alias("fp"), as_bytes())

    def answered(parts, at_shard, at_chunk):
        found = parts.groupBy("shard").applyInArrow(at_shard, _PART)
        by_doc = found.groupBy("flush").applyInArrow(at_chunk, _DOC)
        return by_doc.groupBy("doc_id", "fp").agg(F.first("at").alias("at"))

    hits = answered(rows.mapInArrow(_probes(block, shards), _PART), _active, _hits)
    near = rows.join(hits, ["doc_id", "fp"])
    gone = answered(near.mapInArrow(_windows(window, block, shards), _PART), _smallest, _removed)
    out = rows.join(gone, ["doc_id", "fp"], "left").select("doc_id", "text", "at").mapInArrow(_remove(window, with_text), _OUT)
    return out if with_text else out.drop("kept_text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(documents(spark, sf_dir))
