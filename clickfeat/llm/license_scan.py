"""Licence scan: matching statistics of every text against a generalised suffix automaton of licence templates.

The automaton (built once from the templates, a fixed small table) recognises every run of words of any template.
A text streams through it: after each word it knows the longest run ending there that stands in some template, and
in which ones. Runs that cannot grow are the maximal matches; per template, matches in order with small gaps are
chained into spans, and a template whose words are covered to ``COVER`` gives its label unless a rival covers the same place better. Only runs of words known
to a template enter the automaton, so other text costs a hash lookup per word.

Base phrases are exact places of short word sequences. Odd input: null or empty texts have no words, no labels
(empty strings) and score 0; repeated rows each keep their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as tx
from .common import as_bytes, documents

#: Words are lower-case letters, digits and all characters beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Passages of common licences and their labels. A licence of several passages has one template for each.
_CREATIVE = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives",
             "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License", "agpl": "GNU Affero General Public License"}
_SPDX = ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0-only",
         "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "AGPL-3.0-or-later")
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
            "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
            "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
            "OF MERCHANTABILITY AND FITNESS."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                     "from this software without specific prior written permission."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    *((label, f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation")
      for label, name in _GNU.items()),
    *((label, f"but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} "
              "for more details.") for label, name in _GNU.items()),
    *((label, f"You should have received a copy of the {name} along with this program") for label, name in _GNU.items()),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    *((f"cc-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License") for k, name in _CREATIVE.items()),
    *((f"cc-{k}-4.0", f"Licensed under CC {k.upper()} 4.0") for k in _CREATIVE if k != "by-nc"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    *((name.lower(), f"SPDX-License-Identifier: {name}") for name in _SPDX),
)

#: Least words of a match, largest gap between chained matches, share of a template that gives its label.
MIN_MATCH, MAX_GAP, COVER = 3, 8, 0.8


def words_of(text: str) -> list[bytes]:
    data = tx.LOWER[np.frombuffer(text.encode(), np.uint8)]
    w = tx.split_words(data, np.array([0, len(data)]), WORD_BYTES)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(w.starts, w.ends)]


def hash_of(word: bytes) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    return tx.hash_spans(data, np.array([0]), np.array([len(data)]))[0]


class Automaton:
    """Suffix automaton of several sequences; ``ends[state]``: template -> all places in it where the state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for t, seq in enumerate(sequences):
            last = 0
            for x in seq:
                last = self._extend(last, x)
            state = 0
            for i, x in enumerate(seq):
                state = self.next[state][x]
                up = state
                while up > 0:
                    self.ends[up].setdefault(t, []).append(i)
                    up = self.link[up]

    def _state(self, length, nxt, link):
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p, x, q):
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.ends[copy] = {t: list(at) for t, at in self.ends[q].items()}
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def _extend(self, last, x):
        q = self.next[last].get(x)
        if q is not None:  # this run stands in an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, x, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        return new

    def matches(self, seq, least: int):
        """Maximal matches (start, words, state) of at least ``least`` words."""
        state = size = 0
        for i, x in enumerate(seq):
            if x not in self.next[state] and size >= least:
                yield i - size, size, state
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(x, 0)
            size = size + 1 if state else 0
        if size >= least:
            yield len(seq) - size, size, state


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [name for name, _ in templates]
        texts = [words_of(t) for _, t in templates]
        vocab = sorted({w for t in texts for w in t})
        hashes = np.array([hash_of(w) for w in vocab], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order
        index = {w: i for i, w in enumerate(vocab)}
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton([[index[w] for w in t] for t in texts])
        self.base = [(label, [hash_of(w) for w in words_of(p)]) for p, label in base.items()]

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], -1)

    def spans(self, found: list[tuple[int, int, int]]):
        """(label, first word, end word, share of the template, matched words) of chained matches.

        A match may stand at several places of a template: a chain goes on at the first of them after its last one.
        """
        by: dict[int, list[tuple[int, int, list[int]]]] = {}
        for start, size, state in found:
            for t, ends in self.automaton.ends[state].items():
                by.setdefault(t, []).append((start, size, [e - size + 1 for e in ends]))
        out = []
        for t, ms in by.items():
            chain: list[tuple[int, int, int]] = []  # start, words, place in the template
            for m in [*sorted(ms), None]:
                if chain and m and 0 <= m[0] - chain[-1][0] - chain[-1][1] <= MAX_GAP:
                    place = next((p for p in m[2] if p >= chain[-1][2] + chain[-1][1]), None)
                    if place is not None:
                        chain.append((m[0], m[1], place))
                        continue
                if chain:
                    words = sum(c[1] for c in chain)
                    out.append((self.labels[t], chain[0][0], chain[-1][0] + chain[-1][1], words / self.sizes[t], words))
                chain = [(m[0], m[1], m[2][0])] if m else []
        return out

    def labelled(self, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, str]], float]:
        """Spans that give their label, and the best share. Of two spans of which one lies mostly in the other the one with
        more matched words counts (then the larger share): a passage is not labelled by a licence that it only resembles."""
        spans = self.spans(found)
        good = sorted((s for s in spans if s[3] >= COVER), key=lambda s: (-s[4], -s[3], s[1], s[0]))
        kept: list[tuple] = []
        for s in good:
            rivals = [k for k in kept if 2 * (min(k[2], s[2]) - max(k[1], s[1])) > s[2] - s[1] and k[0] != s[0]]
            if not any((k[4], k[3]) > (s[4], s[3]) for k in rivals):
                kept.append(s)
        return sorted({(s[1], s[2], s[0]) for s in kept}), max([0.0, *(min(1.0, s[3]) for s in spans)])


_OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans string")


def _scan(scanner: Scanner):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tx.text_chunks(batch):
                n_docs = hi - lo
                w = tx.split_words(tx.LOWER[data], offsets, WORD_BYTES)
                h = w.hash
                n_base = np.zeros(n_docs, np.int64)
                first, last = np.full(n_docs, np.iinfo(np.int64).max), np.full(n_docs, -1)
                base_labels: list[set[str]] = [set() for _ in range(n_docs)]
                for label, phrase in scanner.base:
                    k = len(phrase)
                    if len(h) < k:
                        continue
                    hit = h[:len(h) - k + 1] == phrase[0]
                    for j in range(1, k):
                        hit &= h[j:len(h) - k + 1 + j] == phrase[j]
                    at = np.flatnonzero(hit)
                    at = at[w.doc[at] == w.doc[at + k - 1]]
                    d, local = w.doc[at], at - w.first[w.doc[at]]
                    np.add.at(n_base, d, 1)
                    np.minimum.at(first, d, local)
                    np.maximum.at(last, d, local)
                    for x in np.unique(d):
                        base_labels[x].add(label)
                # runs of template words, long enough for a match
                ids = scanner.word_ids(h)
                known = ids >= 0
                cut = np.ones(len(h) + 1, bool)
                cut[1:-1] = (known[1:] != known[:-1]) | (w.doc[1:] != w.doc[:-1])
                edge = np.flatnonzero(cut)
                runs = [(s, e) for s, e in zip(edge[:-1], edge[1:]) if known[s] and e - s >= MIN_MATCH] if len(h) else []
                found: dict[int, list] = {}
                for s, e in runs:
                    d = int(w.doc[s])
                    for m in scanner.automaton.matches(ids[s:e].tolist(), MIN_MATCH):
                        found.setdefault(d, []).append((int(s - w.first[d]) + m[0], m[1], m[2]))
                labels, scores, texts = [], [], []
                for d in range(n_docs):
                    good, best = scanner.labelled(found[d]) if d in found else ([], 0.0)
                    labels.append(",".join(sorted(base_labels[d] | {name for _, _, name in good})))
                    scores.append(max(0.5 if base_labels[d] else 0.0, best))
                    texts.append(",".join(f"{name}:{a}:{b}" for a, b, name in good))
                none = n_base == 0
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(lo, n_docs), "n_words": pa.array(w.counts.astype(np.int64)),
                    "n_base": pa.array(n_base), "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none),
                    "base_labels": pa.array([",".join(sorted(b)) for b in base_labels], pa.string()),
                    "labels": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64()), "spans": pa.array(texts, pa.string())})
    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row per row of ``docs``; spans are ``label:first word:end word``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes())
    return rows.mapInArrow(_scan(Scanner(templates, base)), _OUT)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
