"""Counts of repetition and shape per document, vectorised over a chunk of documents."""

from __future__ import annotations

import numpy as np

from . import textops as tx

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_DOC = np.uint64(0xA24BAED4963EE407)


def byte_sum(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set bytes of each document."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeats(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask: an equal key stands earlier in the same document; and mask: anywhere else in it."""
    k = key + doc.astype(np.uint64) * _DOC
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1] if len(s) else same[1:-1]
    earlier, any_ = np.zeros(len(s), bool), np.zeros(len(s), bool)
    earlier[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return earlier, any_


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines (split at newlines) that hold a word and equal an earlier line of the document."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(n_docs, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    nxt = np.append(starts[1:], len(data))
    ends = np.where((nxt > 0) & (data[nxt - 1] == 10) & (nxt > starts), nxt - 1, nxt)
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(tx.WORD_BYTES[data], out=words[1:])
    full = words[ends] > words[starts]
    starts, ends, doc = starts[full], ends[full], doc[full]
    earlier, _ = repeats(tx.hash_spans(data, starts, ends), doc)
    return np.bincount(doc[earlier], minlength=n_docs)


def repeated_words(words: tx.Words, n: int) -> np.ndarray:
    """Words that stand in a window of ``n`` words found twice or more in the document."""
    pos, g = tx.grams(words, n)
    _, twice = repeats(g, words.doc[pos])
    return tx.per_doc(tx.covered(pos[twice], n, len(words.starts)), words)


def code_points(words: tx.Words) -> np.ndarray:
    """Code points inside words, per document."""
    return byte_sum(tx.WORD_BYTES[words.data] & ((words.data & 0xC0) != 0x80), words.offsets)
