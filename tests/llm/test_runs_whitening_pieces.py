"""Periodic runs, whitening and the sentencepiece codec against brute force, exact arithmetic and the library."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickfeat.llm import periodic_runs, piece_codec, whitening
from clickfeat.llm.common import documents

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


# --- periodic runs

def runs_by_force(w, least=24, power=3):
    out = {}
    for p in range(1, len(w) // power + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(least, power * p):
                out.setdefault((s, i - s + p), p)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words_match_brute_force():
    r = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(r.randrange(1, 4)):
            k, w, size = r.choice([1, 2, 3, 30]), [], r.randrange(0, 160)
            while len(w) < size:
                unit = [r.randrange(k) for _ in range(r.randrange(1, 25))]
                w += unit * r.choice([1, 1, 2, 4, 7])
            docs.append(w)
        first = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
        least, power = r.choice([(24, 3), (6, 3), (10, 4), (3, 3)])
        got = periodic_runs.runs_of(np.array([x for d in docs for x in d], np.uint64), first, least, power)
        want = [(s + int(first[i]), n, p) for i, d in enumerate(docs) for s, n, p in runs_by_force(d, least, power)]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("words,runs", [
    ([7] * 50_000, [(0, 50_000, 1)]), ([1, 2] * 25_000, [(0, 50_000, 2)]), (list(range(50_000)), []),
    (([1] * 30 + [2]) * 1000, None)])
def test_runs_of_one_long_text(words, runs):
    got = periodic_runs.runs_of(np.array(words, np.uint64), np.array([0, len(words)]))
    if runs is None:
        runs = [(0, 31_000, 31)] + [(31 * i, 30, 1) for i in range(1000)]
    assert sorted(got) == sorted(runs)


def test_pairs_follow_the_runs_where_a_passage_stands_thousands_of_times():
    r, words = random.Random(1), []
    for _ in range(3000):
        words += [*range(40), *[10_000 + r.randrange(10**6) for _ in range(30)]]
    assert periodic_runs.runs_of(np.array(words, np.uint64), np.array([0, len(words)])) == []


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_op11_matches_brute_force(spark, odd, which):
    docs = documents(spark, SF) if which == "sf" else odd
    rows = [(r["doc_id"], (r["text"] or "").encode().split()) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1]) < 4000]
    want = []
    for d, w in rows:
        runs = runs_by_force(w)
        want.append((d, len(w), [tuple(x) for x in runs], sha(collapsed(w, runs))))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], sha(r["collapsed"].encode()))
           for r in periodic_runs.periodic_runs(docs).collect() if r["n_words"] < 4000]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op11_query_plants_tails_and_picks_the_longest_run(spark):
    want = {}
    for row in documents(spark, SF).select("doc_id", "text").collect():
        w = (row["text"] or "").encode().split()
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n >= 4000:
            continue
        runs = runs_by_force(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        want[row["doc_id"]] = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines.encode()), sha(collapsed(w, runs)))
    got = {r["doc_id"]: tuple(r)[1:8] for r in periodic_runs.op11_periodic_runs(spark, SF).collect() if r["n_words"] < 4000}
    assert got == want
    assert sum(v[0] for v in want.values())


def test_op11_ties_and_ids(spark):
    """Equal exponents: the smaller start wins; null and repeated ids keep their rows; h = 0 of a null id plants nothing."""
    text = " ".join(["a"] * 30 + ["x"] + ["b"] * 30)
    docs = spark.createDataFrame([(None, text), (3, text), (3, text)], "doc_id long, text string")
    rows = periodic_runs.periodic_runs(periodic_runs.with_periodic_tails(docs.filter("doc_id is null"))).collect()
    assert [tuple(x) for x in rows[0]["runs"]] == [(0, 30, 1), (31, 30, 1)] and rows[0]["collapsed"] == "a x b"
    assert periodic_runs.periodic_runs(docs).count() == 3


# --- whitening

def exact(vectors):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    y = [[n * v[i] - s[i] for i in range(d)] for v in x]
    cov = [[Fraction(sum(v[i] * v[j] for v in y), n**3) for j in range(d)] for i in range(d)]
    return n, s, y, np.array([[float(c) for c in row] for row in cov])


def whiten_all(spark, vectors, **kw):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    return whitening.whitened_components(rows, **kw)


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e9, 1e14])
def test_op12_covariance_is_exact(spark, scale):
    """In 64 bits, in limbs and in Python's numbers: the same matrix as whole-number arithmetic."""
    r = np.random.default_rng(2)
    vectors = (r.normal(0, scale, (60, 5)) @ r.normal(0, 1, (5, 5))).tolist()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got, dims = whitening.vectors_of(rows)
    model = whitening.fit(got, dims)
    n, s, y, cov = exact(vectors)
    assert (model.n, model.sums) == (n, s)
    assert (model.covariance == cov).all()
    far = {r["vec_id"]: r["deviation"] for r in whitening.whiten(got, dims, model).collect()}
    assert {k: None if v is None else int(v) for k, v in far.items()} == {i: v if (v := sum(c * c for c in row)) < 10**38 else None for i, row in enumerate(y)}


def test_square_sums_in_limbs():
    r = np.random.default_rng(3)
    for most in (1 << 20, 1 << 40, (1 << 62) - 1):
        s = r.integers(-most, most, (500, 3))
        assert whitening.square_sums(s) == [sum(int(v) ** 2 for v in s[:, i]) for i in range(3)]
    assert whitening.square_sums(np.array([[-(1 << 61)], [1 << 61]])) == [1 << 123]


def test_op12_on_the_table(spark):
    got = whitening.op12_whitening(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(rows["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    y = len(x) * x - x.sum(0)
    first = got[got["component"] == 1].set_index("vec_id").loc[rows["vec_id"]]
    assert (first["deviation"].to_numpy() == (y * y).sum(1)).all() and (got["n"] == len(x)).all()
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape == (len(x), 32) and np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9
    values = np.linalg.eigvalsh(np.cov((x - 1_000_000).T, bias=True))[::-1]
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, (values / values.sum())[:32], rtol=1e-9)
    assert (np.diff(share) <= 0).all() and got["identity_error"].max() < 1e-9


def test_op12_odd_rows(spark):
    good = [(i, [float(i % 7), float(i % 3), float(i % 5)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [1.0, float("inf"), 2.0]), (105, [1.0, 2.0])]
    rows = spark.createDataFrame(good + [(None, [1.0, 2.0, 3.0])] * 2 + bad, "vec_id long, embedding array<double>")
    for name in ("vector", "key", "n", "at", "component", "whitened", "dims", "count"):
        rows = rows.withColumn(name, F.lit(name))
    out = whitening.whitened_components(rows).collect()
    assert len(out) == 42 * 3 and {r["n"] for r in out} == {42} and sum(r["vec_id"] is None for r in out) == 6
    assert all(r["whitened"] is not None for r in out)


def test_op12_without_variance_and_empty(spark):
    out = whiten_all(spark, [[1.0, 2.0], [1.0, 2.0]]).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in out] == [(c, 0, None, None, None) for c in (1, 2)] * 2
    one = whiten_all(spark, [[0.0, 5.0], [1.0, 5.0], [4.0, 5.0]]).collect()
    assert [r["whitened"] is None for r in one] == [False, True] * 3 and {r["explained"] for r in one} == {1.0, 0.0}
    assert whiten_all(spark, [[1.0]]).limit(0).count() == 0
    assert whitening.whitened_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_op12_falls_in_the_same_place_over_many_partitions(spark):
    r = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(r.normal(0, 1, (300, 6)).tolist())], "vec_id long, embedding array<double>")
    a, b = (whitening.whitened_components(rows.repartition(n), components=3).select("vec_id", "component", "deviation", F.round("whitened", 9).alias("w")).collect() for n in (1, 7))
    assert sorted(a) == sorted(b) and len(a) == 900


# --- sentencepiece

def library(blob):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=blob)


def agrees(codec, lib, text):
    ids, begin, end = codec.encode(text.encode(), end=False)
    want = [(p.id, p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces]
    assert list(zip(ids.tolist(), begin.tolist(), end.tolist())) == want, text
    assert codec.decode(ids.tolist()) == lib.decode(ids.tolist()), text


ODD = ["", "a", " ", "  ", "\n", " a  b  ", "▁", "▁▁a▁", "x▁y", "é̀", "漢字かな" * 20, "😀😀 \t\r\n", "<s></s><unk><0x41>", "a\x00b", "�",
       "abc" * 300, " " * 100, "\n" * 50, "a" * 3000, "ABC0123" * 30, "ﬁ ① Ａ ｶﾞ ½ …", " ​　x"]


def test_codec_agrees_with_the_library(spark):
    blob = piece_codec.read_model(MODEL)
    codec, lib = piece_codec.Codec(blob), library(blob)
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("ab ▁\n\té漢😀\x00<>1.,'eth ") for _ in range(r.randrange(60))) for _ in range(500)]
    texts += [r["text"] or "" for r in documents(spark, SF).select("text").collect()]
    for t in texts:
        agrees(codec, lib, t)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("byte_pieces", [True, False])
def test_codec_agrees_under_other_character_maps(rule, squeeze, prefix, byte_pieces):
    """The vocabulary with the library's own compiled maps, all spacing rules, with and without byte pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    spec, model = pb.NormalizerSpec(), pb.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    model.ParseFromString(piece_codec.read_model(MODEL))
    model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, prefix
    if not byte_pieces:
        model.trainer_spec.byte_fallback = False
        for p in model.pieces:
            if p.type == pb.ModelProto.SentencePiece.BYTE:
                p.type, p.score, p.piece = pb.ModelProto.SentencePiece.NORMAL, -1e8, "" + p.piece
    blob = model.SerializeToString()
    codec, lib, r = piece_codec.Codec(blob), library(blob), random.Random(2)
    letters = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "ﬁ", "①", "Ａ", "ｶﾞ", "́", "😀", "\x00", "　", "​", "▁", "ß", "İ", "½", "the ", "…"]
    for t in ODD + ["".join(r.choice(letters) for _ in range(r.randrange(25))) for _ in range(150)]:
        agrees(codec, lib, t)


def test_decoding_any_ids(spark):
    blob = piece_codec.read_model(MODEL)
    codec, lib, r = piece_codec.Codec(blob), library(blob), random.Random(3)
    lists = [[r.randrange(32_000) if r.random() < 0.5 else r.randrange(262) for _ in range(r.randrange(12))] for _ in range(400)]
    for ids in lists:
        assert codec.decode(ids) == lib.decode(ids)
    rows = spark.createDataFrame([(i, ids) for i, ids in enumerate(lists[:20])] + [(None, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in piece_codec.decode_pieces(rows, blob).collect()}
    assert got == {i: lib.decode(ids) for i, ids in enumerate(lists[:20])} | {None: None}


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_op13_matches_the_library(spark, odd, which, tmp_path):
    docs = documents(spark, SF) if which == "sf" else odd
    lib = library(piece_codec.read_model(MODEL))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = lib.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], ids, lib.decode(ids), len((r["text"] or "").encode())))
    got = piece_codec.encode_pieces(docs, piece_codec.read_model(MODEL), spans=True, decoded=True).collect()
    assert sorted(((r["doc_id"], r["ids"], r["decoded"], r["covered_bytes"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:  # the spans tile the text
        assert len(r["begins"]) == len(r["ends"]) == len(r["ids"]) and r["begins"][1:] == r["ends"][:-1]
    if which == "sf":
        rows = piece_codec.op13_pieces(spark, SF).collect()
        assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(
            (d, len(i), sha(" ".join(map(str, i)).encode()), sha(t.encode())) for d, i, t, _ in want)


def test_one_part_of_megabytes(spark):
    """No white space at all: one part, merged by a heap."""
    text = "".join(random.Random(4).choice("abcdeéß") for _ in range(300_000))
    codec, lib = piece_codec.codec(piece_codec.read_model(MODEL)), library(piece_codec.read_model(MODEL))
    assert codec.encode(text.encode())[0].tolist() == lib.encode(text, add_eos=True)


def test_wrong_bytes_become_replacement_characters():
    codec = piece_codec.codec(piece_codec.read_model(MODEL))
    text, at = codec.normalize(b"a\xff\xe2\x82 b\xc3")
    assert text.decode() == "▁a���▁b�"
    assert at.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 6, 7]


def test_empty_tables(spark, none):
    assert periodic_runs.periodic_runs(none).collect() == []
    assert periodic_runs.periodic_runs(periodic_runs.with_periodic_tails(none)).collect() == []
    assert piece_codec.encode_pieces(none, piece_codec.read_model(MODEL)).collect() == []
