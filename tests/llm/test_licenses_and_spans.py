"""Licences told apart by whole passages, repeated runs of a template, and spans of texts with thousands of secrets."""

import re
import time

import pytest

from clickfeat.llm import license_scan, secret_scan

MIT = dict(license_scan.TEMPLATES)["mit"]


def labels_of(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["labels"] for r in sorted(license_scan.scan_licenses(docs).collect(), key=lambda r: r["doc_id"])]


def test_every_template_gives_its_own_label(spark):
    """Alone, in other text, and with a word put in: its label, and no other than a base label."""
    base = set(license_scan.BASE.values())
    texts = [t for _, t in license_scan.TEMPLATES]
    got = labels_of(spark, *texts, *[f"some words first {t} and then more of them" for t in texts])
    for (name, t), labels in zip([*license_scan.TEMPLATES] * 2, got):
        assert set(labels.split(",")) - base - {name} == set() and name in labels.split(","), t


@pytest.mark.parametrize("name,other", [("Lesser ", "lgpl"), ("Affero ", "agpl"), ("", "gpl")])
def test_gnu_notices(spark, name, other):
    text = (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or any later version.")
    assert labels_of(spark, text) == [",".join(sorted({"gpl", other}))]  # the base phrase stands in all three


def test_identifiers(spark):
    got = labels_of(spark, *[f"# SPDX-License-Identifier: {n}\nimport os" for n in license_scan._SPDX], "SPDX-License-Identifier: Zlib")
    assert got == [n.lower() if "BY" not in n else ",".join(sorted({"cc-by", n.lower()})) for n in license_scan._SPDX] + [""]


def test_runs_that_stand_twice_in_a_template():
    scanner = license_scan.Scanner((("x", "a b c d e f a b c g h i a b c j k l"),))
    words = "a b c d e f zz a b c g h i zz a b c j k l".split()
    ids = scanner.word_ids(__import__("numpy").array([license_scan.hash_of(w.encode()) for w in words])).tolist()
    found = []
    start = 0
    for part in " ".join("|" if i < 0 else str(i) for i in ids).split("|"):
        seq = [int(x) for x in part.split()]
        found += [(start + s, n, state) for s, n, state in scanner.automaton.matches(seq, 3)]
        start += len(seq) + 1
    assert scanner.labelled(found) == ([(0, 20, "x")], 1.0)


def test_ends_hold_all_places():
    seqs = [[1, 2, 1, 2, 3, 1, 2], [2, 3, 1, 2, 2]]
    auto = license_scan.Automaton(seqs)
    for t, s in enumerate(seqs):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                state = 0
                for x in s[i:j]:
                    state = auto.next[state][x]
                want = [e for e in range(j - i - 1, len(s)) if s[e - (j - i) + 1:e + 1] == s[i:j]]
                assert auto.ends[state][t] == want


def test_plain_prose_has_no_label(spark):
    assert labels_of(spark, "the software is good and the authors of the book use it in source and binary form", "", None) == ["", "", ""]


def test_spans_of_thousands_of_secrets(spark):
    """Linear: ten thousand hex tokens in one text, all spans exact."""
    token = "deadbeef" * 4
    text = " ".join(f"é{i} {token}{i % 7}" for i in range(10_000))
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string")
    secret_scan.secret_report(docs.limit(0)).collect()
    began = time.time()
    got = {r["doc_id"]: r for r in secret_scan.secret_report(docs).collect()}
    took = time.time() - began
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
    assert got[1]["n_hex"] == 10_000 and got[2]["spans"] == got[3]["spans"] == ""
    assert [tuple(map(int, s.split(":")[1:])) for s in got[1]["spans"].split(",") if s.startswith("hex:")] == want
    assert took < 20, took


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 513])
def test_spans_at_the_edges_of_blocks(spark, n):
    text = " x ".join(["0123456789abcdef01234567"] * n) + " end"
    row = secret_scan.secret_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["spans"] == ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{24,}", text))


def test_clashing_names_in_the_secret_scan(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "password=abcdef1")], "doc_id long, text string")
    for name in ("k1", "k2", "gram", "kind", "rules", "low", "size", "n", "alternative"):
        docs = docs.withColumn(name, F.lit(name))
    row = secret_scan.find_secrets(docs).first()
    assert row["k1"] == "k1" and len(row["base_spans"]) == 1
