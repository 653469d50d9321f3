"""Periodic runs: stretches of a text that repeat a few words over and over, found as maximal pairs.

A maximal pair (i, i + d) of depth l is two places from which l words agree, whose next words differ and whose words
before differ. It spells a stretch of l + d words with period d that no neighbouring word extends. So the runs of at
least ``least`` words and ``power`` periods are the maximal pairs with l >= (power - 1) d and l + d >= ``least``: nothing
is extended. A pair at a multiple of the smallest period spells the same stretch, of which the smallest d stays.

Of a chunk of documents, those in which some ``shallow`` words repeat (``shallow`` is the least depth of any such pair) get

1. a suffix array by prefix doubling over all of them at once (ranks hold the document, so none crosses), and the common
   prefixes of neighbours from the ranks of all levels;
2. a bottom-up walk of the tree of LCP intervals from ``shallow`` down. Each interval keeps its places in order and, by
   the word before them, in class lists; the smaller child is looked up in the larger and then moved to it.

A lookup visits two classes at most. Places of one interval that are at most l / 2 apart are whole smallest periods
apart, so on either side of a place all but the leftmost have the same word before them: the classes of the
two ends of the reach are all there are. So the work follows the places and the pairs found, also in long runs.

No row is shuffled. Words are told apart by 64-bit hashes within one document. Odd input: null and empty texts have no
words; null, equal and repeated ids each keep their row; only ``doc_id`` and ``text`` are read of ``docs``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as tx
from .common import as_bytes, documents
from .textstats import repeats

LEAST, POWER = 24, 3


def shallowest(least: int = LEAST, power: int = POWER) -> int:
    """The least depth of a pair that makes a run."""
    return min(max(least - d, (power - 1) * d) for d in range(1, least + 1))


def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def suffixes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Places in suffix order, ranks of 1, 2, 4, ... words by place, and the end of each place's document.

    ``first[d]:first[d + 1]`` are the words of document d. A document's end sorts first.
    """
    n, sizes = len(words), np.diff(first)
    doc, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(first[1:], sizes)
    order = np.lexsort((words, doc))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    levels, step = [_ranks(order, new)], 1
    while not new.all():
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        inside = np.arange(n) + step < end
        after[inside] = rank[np.flatnonzero(inside) + step] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        new[1:] = both[order][1:] != both[order][:-1]
        levels.append(_ranks(order, new))
        step *= 2
    return order, levels, end


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that neighbours in suffix order have in common."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    end_a, end_b = end[order[:-1]], end[order[1:]]
    for k in range(len(levels) - 1, -1, -1):
        same = (a < end_a) & (b < end_b)
        same &= levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        a += same.astype(np.int64) << k
        b += same.astype(np.int64) << k
    return a - order[:-1]


class _Interval:
    """Places of an LCP interval, and by the word before them."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, before: int):
        self.places, self.classes = [place], {before: [place]}

    def take(self, other: "_Interval") -> None:
        for p in other.places:
            insort(self.places, p)
        for c, mine in other.classes.items():
            have = self.classes.get(c)
            if have is None:
                self.classes[c] = mine
            else:
                for p in mine:
                    insort(have, p)


def _pairs(small: _Interval, large: _Interval, depth: int, before: list[int], least: int, power: int, runs: dict) -> None:
    """Maximal pairs of depth ``depth`` between two children of an interval that make runs."""
    reach, near = depth // (power - 1), least - depth
    places = large.places
    for c, own in small.classes.items():
        for j in own:
            lo, hi = bisect_left(places, j - reach), bisect_right(places, j + reach)
            if lo == hi:
                continue
            for other in {before[places[lo]], before[places[hi - 1]]} - {c}:
                there = large.classes[other]
                for i in there[bisect_left(there, j - reach):bisect_right(there, j + reach)]:
                    start, d = (i, j - i) if i < j else (j, i - j)
                    if d >= near:
                        stretch = start, depth + d
                        if runs.get(stretch, d) >= d:
                            runs[stretch] = d


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; starts count over all ``words``."""
    if power < 3:
        raise ValueError("runs of fewer than three periods are not supported")
    shallow = shallowest(least, power)
    if not len(words):
        return []
    order, levels, end = suffixes(words, first)
    depth = common_prefixes(order, levels, end)
    deep = np.flatnonzero(depth >= shallow)
    if not len(deep):
        return []
    cuts = np.flatnonzero(np.diff(deep) > 1) + 1
    starts = np.zeros(len(words), bool)
    starts[first[:-1][first[:-1] < len(words)]] = True
    before_all = np.concatenate([[-1], levels[0][:-1]])
    before_all[starts] = -1
    before = before_all.tolist()
    runs: dict[tuple[int, int], int] = {}

    def joined(a: _Interval, b: _Interval, at: int) -> _Interval:
        if len(a.places) < len(b.places):
            a, b = b, a
        _pairs(b, a, at, before, least, power, runs)
        a.take(b)
        return a

    for part in np.split(deep, cuts):
        places = order[part[0]:part[-1] + 2].tolist()
        open_: list[list] = []
        done = _Interval(places[0], before[places[0]])
        for at, place in zip([*depth[part].tolist(), 0], [*places[1:], -1]):
            while open_ and open_[-1][0] > at:
                above = open_.pop()
                done = joined(above[1], done, above[0])
            if place < 0:
                break
            if open_ and open_[-1][0] == at:
                open_[-1][1] = joined(open_[-1][1], done, at)
            else:
                open_.append([at, done])
            done = _Interval(place, before[place])
    return sorted((s, n, d) for (s, n), d in runs.items())


def _document_runs(w: tx.Words, least: int, power: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each document of a chunk, starts counted from its first word."""
    out: list[list] = [[] for _ in range(len(w.first) - 1)]
    pos, g = tx.grams(w, shallowest(least, power))
    if not len(pos):
        return out
    _, twice = repeats(g, w.doc[pos])
    some = np.unique(w.doc[pos[twice]])
    if not len(some):
        return out
    counts = w.counts[some]
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(w.first[some] - first[:-1], counts) + np.arange(first[-1])
    for start, length, period in runs_of(w.hash[at], first, least, power):
        d = int(np.searchsorted(first, start, "right")) - 1
        out[some[d]].append((int(start - first[d]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def _scan(least: int, power: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tx.text_chunks(batch):
                w = tx.split_words(data, offsets)
                found = _document_runs(w, least, power)
                raw, cuts = data.tobytes(), offsets.tolist()
                texts = []
                for a, b, runs in zip(cuts, cuts[1:], found):
                    words = raw[a:b].split()
                    if runs:
                        kept = np.ones(len(words), bool)
                        for start, length, period in runs:
                            kept[start + period:start + length] = False
                        words = compress(words, kept.tolist())
                    texts.append(b" ".join(words))
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_words": pa.array(w.counts, pa.int64()),
                    "runs": pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], _RUNS),
                    "collapsed": pa.array(texts, pa.binary())})
    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row.

    Of each run the first period stays; a word that some run holds after that is dropped, kept words are joined by spaces.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes())
    return rows.mapInArrow(_scan(least, power), _SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the tails that the query's contract plants in about a tenth of the documents.

    With h the crc32 of the id and g = h div 10: if h is a multiple of 10, the words from a = g mod n on repeat the first
    1 + (n - a) div (3 + g mod 8) of them. Rows without id or words stay as they are.
    """
    text, h = F.col("text").cast("string"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % F.nullif(n, F.lit(0))).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, period), F.ceil((n - a) / period).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when((h % 10 == 0) & (n > 0), planted).otherwise(text).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periodic_tails(documents(spark, sf_dir)))
    run = "struct<start:bigint,length:bigint,period:bigint>"
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", F.lit(None).cast(run), longer)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
