"""Vectorised text helpers used inside Arrow tasks.

Texts arrive as the raw bytes of an Arrow binary column. Every helper works on one
bounded chunk of documents (about ``limit`` bytes, or a single longer document), so
the memory of a task does not depend on the size of its partition.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D`` unless another byte table
is given; all multi-byte UTF-8 characters belong to words. Word hashes are 64-bit
polynomial hashes with a final mix; two different words collide with a chance of
about 2^-64, which every operator here accepts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
#: Ids that are null sort after all others.
NULL_ID = (1 << 63) - 1

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True
WORD_BYTES = ~SPACE_BYTES
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_MULT = 0xD1342543DE82EF95
_MULT_INV = pow(_MULT, -1, 1 << 64)
_GRAM = _U(0x9E3779B97F4A7C15)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash multiplier and of its inverse modulo 2^64, grown on demand."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_MULT, _MULT_INV):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        if size > 8 * CHUNK_BYTES:  # one very long text: do not keep its tables
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (in place on a fresh array)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]``."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[:len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << _U(48)))


@dataclass
class Words:
    """The words of a chunk of documents; ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @cached_property
    def hash(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """Yield (first row, end row, bytes, document offsets) of whole documents, about ``limit`` bytes each."""
    col = batch.column(column)
    if col.null_count:
        col = pc.fill_null(col, b"")
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if not n:
        return
    _, offs, raw = col.buffers()
    offsets = np.frombuffer(offs, kind)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTES) -> Words:
    """Words of every document (runs of bytes set in ``table``; never across documents)."""
    inside = table[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[cuts] = inside[cuts]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``n`` words inside one document."""
    h = words.hash
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos = np.flatnonzero(words.first[words.doc[:len(h) - n + 1] + 1] - np.arange(len(h) - n + 1) >= n)
    g = h[pos].copy()
    for k in range(1, n):
        g *= _GRAM
        g += h[pos + k]
    return pos, mix(g)


def per_doc(values: np.ndarray, words: Words) -> np.ndarray:
    """Sum of a value per word over each document (integers)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[words.first[1:]] - total[words.first[:-1]]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of ``size`` positions that lie in [s, s + n) of any start."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, np.minimum(starts + n, size), 1)
    return np.cumsum(step[:size]) > 0


def pack(a: np.ndarray, ordered: bool = False) -> bytes:
    """An integer array as bytes: differences if ordered, byte planes, zstd."""
    a = np.ascontiguousarray(a)
    if ordered and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
    return len(a).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(raw: bytes, kind, ordered: bool = False) -> np.ndarray:
    """Inverse of :func:`pack`."""
    kind = np.dtype(kind)
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(raw[8:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)
    return np.cumsum(a, dtype=kind) if ordered else a


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash by its upper 32 bits (equal ranges)."""
    return (((h >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def ids_of(column) -> np.ndarray:
    """An Arrow id column as int64, nulls as NULL_ID."""
    return np.asarray(pc.fill_null(column.cast(pa.int64()), NULL_ID)).astype(np.int64)
