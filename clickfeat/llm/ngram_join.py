"""Near-duplicate documents by an n-gram Jaccard self-join: a blocked sparse product of the document by
n-gram incidence matrix, with size-derived bounds.

Two documents link when ``100 * overlap >= threshold * union`` of their distinct word shingles.

1. *Classes.* Documents with the same shingle set form one class (set fingerprint), so any number of exact
   copies is one row of the matrix.
2. *Candidate columns.* A fixed-size count sketch orders shingles from rare to frequent. Two sets that link
   share a shingle among the first ``n - ceil(t n) + 1`` of each set in that order (n = set size), so only
   those entries of the matrix can start a pair, and columns of very common passages are not among them
   unless a document is made of little else.
   Sizes and places in the order bound what a pair can still share; short columns drop pairs below that bound
   at once, long ones (thousands of near copies) only pair each class with their smallest.
3. *Signatures.* Each class has ``SIGNATURE_WORDS`` x 64 bits: the parities of its shingles by hash cell. Two sets
   differ in at least as many shingles as their parities differ in bits, and two that link differ in at most
   ``(100 - t) / (100 + t)`` of their joint size, so pairs beyond that are never written or tested. Documents made of
   the same few passages share columns with most others, but fall out here without a look at their texts.
4. *Blocks.* Only texts of classes in a pair are shuffled: a bitmap of fixed size keeps the others out. Classes
   with the same smallest partner form a block (split by hash beyond ``BLOCK_ROWS`` rows or ``BLOCK_CELLS`` entries, the
   smallest class in each part). A task multiplies a block's rows with their transpose: overlap counts are accumulated
   per row with ``bincount`` over the columns, and pairs below the bound of their two sizes are discarded.
5. *Rest.* Links are contracted to components. Every pair of classes that still shares a candidate column
   across two components, and that passes the bounds by sizes, position in the order and signatures, is multiplied
   exactly too. After that no link can be missing, and copies were never expanded into all pairs.

A column is counted by an aggregate, not by a window: no task holds a column. Columns of one class only are dropped
before their entries are shuffled, behind a bitmap of fixed size. Tables that grow with the input are joined by sort and
merge at any size, so the driver builds and holds no copy of one while it is small; joins with a sum by a key that many
classes may share (block, column, component) are left to Spark, as it can not split such a key in a merge join.

Shingles are 64-bit hashes. Null or wordless texts are linked with nothing; a null id sorts after all ids
(a component of null ids only has a null id); repeated rows each keep their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as tx
from .common import as_bytes, documents, fingerprint, merged, written

SHINGLE_WORDS = 5
THRESHOLD = 80
SKETCH_BITS = 22
#: Rows and entries (shingles) of one block of the product; one larger row stands with the smallest class only.
BLOCK_ROWS, BLOCK_CELLS = 256, 1 << 21
#: 64-bit words of a class's signature.
SIGNATURE_WORDS = 32
#: Columns of at most so many entries give all their pairs at once; longer ones go through blocks first.
SHORT_COLUMN = 64
#: Bits of the filter that keeps rows of unasked keys out of a shuffle (4 MB whatever the input).
FILTER_BITS = 25

_U = np.uint64


def _sets(data, offsets, k):
    """Sorted distinct shingle hashes of every document (a shorter text is one shingle)."""
    w = tx.split_words(tx.LOWER[data], offsets)
    pos, g = tx.grams(w, k)
    cut = np.searchsorted(pos, w.first)
    for d in range(len(offsets) - 1):
        if cut[d + 1] > cut[d]:
            yield np.unique(g[cut[d]:cut[d + 1]])
        else:
            h = w.hash[w.first[d]:w.first[d + 1]]
            if not len(h):
                yield h
            else:
                whole = _U(len(h))
                for x in h:
                    whole = tx.mix(np.array([whole * _U(0x9E3779B97F4A7C15) + x]))[0]
                yield np.array([whole])


def _class_of(s: np.ndarray) -> int:
    """Order-free fingerprint of a set."""
    if not len(s):
        return 0
    a = int(tx.mix(s + _U(0x1234567)).sum(dtype=np.uint64)) * 3 + len(s)
    return int(tx.mix(np.array([a & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])


def _signature(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles of a set by hash cell, as whole numbers of 64 bits."""
    bits = 64 * SIGNATURE_WORDS
    cell = ((s >> _U(40)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _batches(batches, k):
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo, hi, data, offsets in tx.text_chunks(batch):
                yield batch, lo, hi, list(_sets(data, offsets, k))


_DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()),
                         ("signature", pa.list_(pa.int64()))])


def _classes(k):
    def run(batches):
        for batch, lo, hi, sets in _batches(batches, k):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("print").slice(lo, hi - lo),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SIGNATURE_WORDS),
                                          pa.array(np.concatenate([_signature(s) for s in sets])))], schema=_DOC_SCHEMA)
    return run


_PIECE = 1 << 14


def _sketch_counts(k, bits):
    schema = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        total = np.zeros(1 << bits, np.uint32)
        for _, _, _, sets in _batches(batches, k):
            cell, n = np.unique((np.concatenate(sets) & _U((1 << bits) - 1)).astype(np.uint32), return_counts=True)
            total[cell] += n.astype(np.uint32)
        if total.any():
            pieces = range(0, 1 << bits, _PIECE)
            yield pa.RecordBatch.from_arrays([pa.array([p // _PIECE for p in pieces], pa.int32()),
                                              pa.array([tx.pack(total[p:p + _PIECE]) for p in pieces], pa.binary())], schema=schema)
    return run


def _sum_piece(table: pa.Table) -> pa.Table:
    total = np.zeros(_PIECE, np.uint64)
    for c in table.column("counts"):
        total += tx.unpack(c.as_py(), np.uint32)
    # frequency classes: two per doubling
    level = (2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table({"piece": table.column("piece").slice(0, 1), "levels": pa.array([level.tobytes()], pa.binary())})


def frequency_levels(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """Frequency class of every sketch cell (2^bits bytes, whatever the input)."""
    parts = docs.mapInArrow(_sketch_counts(k, bits), "piece int, counts binary").groupBy("piece").applyInArrow(
        _sum_piece, "piece int, levels binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for p in parts:
        out[p["piece"] * _PIECE:(p["piece"] + 1) * _PIECE] = np.frombuffer(p["levels"], np.uint8)
    return out


_POSTING = pa.schema([("gram", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])


def _prefixes(k, threshold, levels, bits, wanted=None):
    """Entries of candidate columns; with ``wanted`` (a bitmap of columns) only of those that may be in it."""
    def run(batches):
        seen: set[int] = set()
        rank = levels.value
        mark = None if wanted is None else wanted.value
        for _, _, _, sets in _batches(batches, k):
            grams, clss, ns, ats = [], [], [], []
            for s in sets:
                n = len(s)
                c = _class_of(s)
                if not n or c in seen:
                    continue
                if len(seen) < 200_000:  # copies in one task; the rest collapse after the shuffle
                    seen.add(c)
                m = n - -(-threshold * n // 100) + 1
                lv = rank[s & _U((1 << bits) - 1)]
                g, at = s[np.lexsort((s, lv))[:m]], np.arange(m, dtype=np.int32)
                if mark is not None:
                    spot = (g & _U((1 << FILTER_BITS) - 1)).astype(np.int64)
                    at = at[(mark[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
                    g = g[at]
                grams.append(g)
                clss.append(np.full(len(g), c))
                ns.append(np.full(len(g), n, np.int32))
                ats.append(at)
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(clss)),
                                                  pa.array(np.concatenate(ns)), pa.array(np.concatenate(ats))], schema=_POSTING)
    return run


_SET = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("grams", pa.binary())])


def _set_rows(k):
    def run(batches):
        for batch, lo, hi, sets in _batches(batches, k):
            want = tx.ids_of(batch.column("cls"))[lo:hi]
            keep = [(c, len(s), s.tobytes()) for c, s in zip(want, sets) if _class_of(s) == c]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*keep), _SET.types)], schema=_SET)
    return run


def _product(k, threshold):
    """Links inside one block of texts: rows of shingle sets times their transpose, one row of counts at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        cls, rows = [], []
        for batch, lo, hi, found in _batches(table.to_batches(), k):
            cls.extend(tx.ids_of(batch.column("cls"))[lo:hi])
            rows.extend(found)
        n, cls = np.array([len(s) for s in rows], np.int64), np.array(cls, np.int64)
        order = np.lexsort((cls, n))
        _, once = np.unique(cls[order], return_index=True)
        order = order[np.sort(once)]
        cls, n = cls[order], n[order]
        sets = [rows[i] for i in order]
        size = len(sets)
        label = np.arange(size)
        links = []
        if size > 1:
            _, col = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(n)
            row_of = np.repeat(np.arange(size), n)
            by_col = np.argsort(col, kind="stable")
            col_start = np.searchsorted(col[by_col], np.arange(col.max() + 2))
            members = row_of[by_col]
            for i in range(size - 1):
                # partners are at least as large, up to 100/threshold of this size, and not linked already
                top = np.searchsorted(n, 100 * n[i] // threshold, "right")
                if top <= i + 1 or (label[i + 1:top] == label[i]).all():
                    continue
                mine = col[ends[i] - n[i]:ends[i]]
                spans = [members[col_start[c]:col_start[c + 1]] for c in mine]
                overlap = np.bincount(np.concatenate(spans), minlength=size)[i + 1:top]
                hit = np.flatnonzero(100 * overlap >= threshold * (n[i] + n[i + 1:top] - overlap)) + i + 1
                for j in hit:
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        links.append((cls[i], cls[j]))
        a, b = zip(*links) if links else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
    return run


def _pair_product(threshold):
    """Exact test of pairs of rows (the remaining cells of the product)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[i].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column("y")[i].as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                overlap = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                if 100 * overlap >= threshold * (len(x) + len(y) - overlap):
                    keep.append(i)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))
    return run


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(cls, label): the smallest class reachable over ``links`` (a, b); classes without links are absent.

    Min-label spreading with pointer jumping; each round is written to the shared folder.
    """
    ends = links.select(F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")))).alias("e"))
    both = written(ends.select("e.a", "e.b").distinct(), name)
    labels = written(both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("label")), name)
    while True:
        # the edge of a class to itself brings its own label along
        step = both.join(merged(labels), both["b"] == labels["cls"]).groupBy("a").agg(
            F.min("label").alias("step"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        up = labels.select(F.col("cls").alias("step"), F.col("label").alias("up"))
        nxt = written(step.join(merged(up), "step").select(F.col("a").alias("cls"), F.least("step", "up").alias("label"), "old"), name)
        if not nxt.filter("label != old").limit(1).count():
            return nxt.select("cls", "label")
        labels = nxt.select("cls", "label")


def column_bitmap(columns: DataFrame) -> np.ndarray:
    """Bits of the low ``FILTER_BITS`` bits of every ``gram`` (4 MB whatever the input)."""
    spot = F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    pieces = columns.groupBy(F.bitmap_bucket_number(spot).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for p in pieces.collect():
        bits = np.frombuffer(p["bits"], np.uint8)
        out[(p["piece"] - 1) * len(bits):p["piece"] * len(bits)] = bits
    return out


def asked_only(rows: DataFrame, key: list[str], asked: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``rows`` whose ``key`` may be one of ``asked``: all that are, and few others while ``asked`` has fewer than 2^bits keys.

    The filter is a bitmap of 2^bits bits in pieces of 4 KB, so its broadcast has a fixed size.
    """
    spot = F.pmod(F.xxhash64(*key), F.lit(1 << bits))
    pieces = asked.select(spot.alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_spot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = F.getbit(byte, (F.bitmap_bit_position("_spot") % 8).cast("int")) == 1
    return rows.withColumn("_spot", spot).withColumn("_piece", F.bitmap_bucket_number("_spot")).join(
        F.broadcast(pieces), "_piece").filter(marked).select(*rows.columns)


def component_rows(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD,
                   sketch_bits: int = SKETCH_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The columns of :func:`jaccard_components`, ``print`` (the text's fingerprint) and ``first``: whether id and print
    are the smallest of the row's component (ids can be repeated or null, so ``component_id`` does not tell)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(tx.NULL_ID)).alias("doc_id"), as_bytes(), fingerprint().alias("print"))
    texts = rows.select("text")
    member = written(rows.mapInArrow(_classes(k), "doc_id long, print long, n_shingles long, cls long, signature array<long>"), "join-classes")
    signed = written(member.filter("n_shingles > 0").select("cls", F.col("n_shingles").alias("size"), "signature").dropDuplicates(["cls"]),
                     "join-signatures")
    # one row stands for its class: the smallest id, with the fingerprint of its text as ids can be repeated
    heads = member.filter("n_shingles > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "print")).alias("first")).select(
        "cls", F.col("first.doc_id").alias("head"), F.col("first.print").alias("print"))

    def texts_of(asked: DataFrame) -> DataFrame:
        """``asked`` (cls, ...) with the text of each class; other texts are not shuffled."""
        need = written(asked.join(merged(heads), "cls").withColumnRenamed("head", "doc_id"), "join-asked")
        row = ["doc_id", "print"]
        return asked_only(rows, row, need).dropDuplicates(row).join(merged(need), row).select(*asked.columns, "text")

    levels = spark.sparkContext.broadcast(frequency_levels(texts, k, sketch_bits))
    entry = "gram long, cls long, n int, at int"
    columns = written(texts.mapInArrow(_prefixes(k, threshold, levels, sketch_bits), entry).groupBy("gram").agg(
        F.min("cls").alias("least"), F.max("cls").alias("most"), F.count("*").alias("rows")).filter("least != most").drop("most"), "join-columns")
    wanted = spark.sparkContext.broadcast(column_bitmap(columns))
    shared = written(texts.mapInArrow(_prefixes(k, threshold, levels, sketch_bits, wanted), entry).distinct().join(merged(columns), "gram"), "join-entries")
    # all that read them is written: the driver holds no copy either
    levels.destroy()
    wanted.destroy()

    def within(x, y):
        """Cells of two classes in one column that the sizes and the places in the order allow to be linked."""
        return F.expr(f"{x}.gram = {y}.gram and {x}.cls < {y}.cls and 100 * least({x}.n, {y}.n) >= {threshold} * greatest({x}.n, {y}.n) "
                      f"and least({x}.n - {x}.at, {y}.n - {y}.at) * {100 + threshold} >= {threshold} * ({x}.n + {y}.n)")

    # sets whose parities differ in more bits than linked sets differ in shingles are not linked
    bits = " + ".join(f"bit_count(a_signature[{i}] ^ b_signature[{i}])" for i in range(SIGNATURE_WORDS))
    alike = F.expr(f"({bits}) * {100 + threshold} <= (a_size + b_size) * {100 - threshold}")

    def sign(df, c):
        """``df`` with size and signature of the class in its column ``c``."""
        return df.join(merged(signed.select(F.col("cls").alias(c), F.col("size").alias(f"{c}_size"), F.col("signature").alias(f"{c}_signature"))), c)

    # short columns give their few pairs at once; a long one only pairs its classes with its smallest
    short = shared.filter(F.col("rows") <= SHORT_COLUMN)
    few = short.alias("x").join(merged(short.alias("y")), within("x", "y")).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    few = sign(sign(few, "a"), "b").filter(alike).select("a", "b")
    star = shared.filter((F.col("rows") > SHORT_COLUMN) & (F.col("least") != F.col("cls"))).select(F.col("least").alias("a"), F.col("cls").alias("b"))
    near = written(few.union(star).distinct(), "join-pairs")

    # blocks: each class joins the block of its smallest partner; a block's head stands in each of its parts
    edge = near.select(F.col("b").alias("cls"), F.col("a").alias("block")).union(near.select(F.col("a"), F.col("a")))
    block = edge.groupBy("cls").agg(F.min("block").alias("block"))
    parts = block.join(merged(signed.select("cls", "size")), "cls").groupBy("block").agg(
        F.ceil(F.greatest(F.count("*") / block_rows, F.sum("size") / BLOCK_CELLS)).alias("parts"))
    placed = written(block.join(parts, "block").select("block", "cls", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part")), "join-places")
    leads = parts.select("block", F.col("block").alias("cls"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rows_of = texts_of(placed.union(leads.select("block", "cls", "part")).distinct())
    links = written(rows_of.groupBy("block", "part").applyInArrow(_product(k, threshold), "a long, b long"), "join-links")
    labels = components(links)

    # the remaining cells: pairs across components that share a candidate column within the bounds
    def label_of(c):
        return merged(labels.select(F.col("cls").alias(c), F.col("label").alias(f"{c}_label")))

    def spot_of(c):
        return merged(placed.select(F.col("cls").alias(c), F.col("block").alias(f"{c}_block"), F.col("part").alias(f"{c}_part")))

    # pairs of one block part, or of a block and its head, are cells of the product already
    apart = (F.coalesce("a_label", "a") != F.coalesce("b_label", "b")) & (F.col("a_block") != F.col("b")) & (F.col("b_block") != F.col("a")) & (
        (F.col("a_block") != F.col("b_block")) | (F.col("a_part") != F.col("b_part")))
    rest = near.join(spot_of("a"), "a").join(spot_of("b"), "b").join(label_of("a"), "a", "left").join(
        label_of("b"), "b", "left").filter(apart).select("a", "b")
    long = shared.filter(F.col("rows") > SHORT_COLUMN).join(merged(labels), "cls", "left").select(
        "gram", "cls", "n", "at", F.coalesce("label", "cls").alias("label"))
    span = long.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("gram")
    open_ = written(long.join(span, "gram"), "join-long")  # read as either side below
    x = sign(open_.withColumnRenamed("cls", "a"), "a").withColumn("cls", F.col("a"))
    y = sign(open_.withColumnRenamed("cls", "b"), "b").withColumn("cls", F.col("b"))
    across = x.alias("x").join(merged(y.alias("y")), within("x", "y") & F.expr("x.label != y.label") & alike).select("a", "b")
    pairs = written(rest.union(across).distinct(), "join-open")
    both = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    sets = written(texts_of(both).mapInArrow(_set_rows(k), "cls long, n int, grams binary"), "join-sets")
    tested = pairs.join(merged(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x"))), "a").join(
        merged(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y"))), "b").select("a", "b", "x", "y")
    more = written(tested.mapInArrow(_pair_product(threshold), "a long, b long").distinct(), "join-rest")
    of_class = heads.join(merged(labels), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    if more.limit(1).count():
        # these links join whole components: only their labels go through the rounds again
        over = more.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left").select(
            F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
        root = components(over).select(F.col("cls").alias("label"), F.col("label").alias("root"))
        of_class = of_class.join(merged(root), "label", "left").withColumn("label", F.coalesce("root", "label"))
    of_class = written(of_class.select("cls", "head", "print", "label"), "join-labels")  # read twice below
    least = of_class.groupBy("label").agg(F.min(F.struct("head", "print")).alias("least")).select(
        "label", F.col("least.head").alias("component"), F.col("least.print").alias("least_print"))
    answer = of_class.join(least, "label").select("cls", "component", "least_print")
    wordless = F.col("n_shingles") == 0
    null_safe = lambda c: F.when(c != F.lit(tx.NULL_ID), c)
    return member.join(merged(answer), "cls", "left").select(
        null_safe(F.col("doc_id")).alias("doc_id"), "n_shingles",
        null_safe(F.when(wordless, F.col("doc_id")).otherwise(F.col("component"))).alias("component_id"), "print",
        (wordless | ((F.col("doc_id") == F.col("component")) & (F.col("print") == F.col("least_print")))).alias("first"))


def jaccard_components(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD,
                       sketch_bits: int = SKETCH_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    return component_rows(docs, k, threshold, sketch_bits, block_rows).select("doc_id", "n_shingles", "component_id")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
