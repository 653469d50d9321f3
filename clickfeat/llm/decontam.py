"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers (also number words), names (capitalised words, at the start of a sentence too unless they are ordinary
openers) and units (after a number) become typed placeholders, other words are lower-cased, punctuation goes. A document leaks an item when they share windows of template words and the
slots agree: the values behind equal placeholders must map one to one (all the same: a copy; others, one to one: a
question with new parameters).

1. All windows of ``WINDOW`` template words of the items are hashed. Documents probe with every ``STRIDE``-th window,
   or more often where an item reaches ``COVER`` with shorter runs (:func:`longest_run`), so that no document that
   reaches it is missed. Items under ``WINDOW + STRIDE - 1`` words are probed with windows of their own length at
   every place.
2. Only documents with a hit are cut into all windows, joined with the items', and their slots compared.

What stands before an item decides whether its first word is capitalised (or a unit) in a document: windows of documents
that begin with such a placeholder also count with the word itself, and so does an item's first window. Items of fewer than ``LEAST_WORDS`` template words
have no template to speak of: they leak into documents that hold their raw words in a row (one window, coverage 1), an
item of one word into documents that are this word alone, or that hold it if it is in a script without spaces.

A pair leaks when at least ``COVER`` of the item's windows are found, in order in the item and in the document (words may
be put in, left out or replaced between them: :func:`best_chain`), and its slots are consistent. The item side is
broadcast only under ``BROADCAST_WINDOWS`` windows. Odd input: null or empty texts and items have no words and match
nothing; null ids are kept as null ids; rows with equal id and text give one result per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, fingerprint, written

WINDOW, STRIDE, COVER = 8, 4, 0.5
#: Items of fewer template words are searched for by their raw words only.
LEAST_WORDS = 4
#: A word with such characters can be a clause.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
BROADCAST_WINDOWS = 1_000_000

NUM, NAME, UNIT = "\ue000", "\ue001", "\ue002"
# Unit words.
UNITS = ("mm cm m km kg g mg l ml s sec seconds min minutes h hours days weeks months years miles feet inches pounds "
         "dollars euros cents percent degrees usd eur kmh mph watts volts")
# Number words (English, German, French, Spanish; without those that are articles or pronouns too).
NUMBER_WORDS = ("zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
                "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
                "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend "
                "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante cent mille "
                "dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta cien mil")
# Words that open sentences and are no names (the same languages).
OPENERS = ("the a an this that these those it he she they we you there here what which who whose when where why how if in on at by for from with "
           "as of to and or but so not no yes one is are was were do does did has have had can could will would let each every some any all both many "
           "after before while then his her its their our my your find given suppose write name explain choose "
           "der die das ein eine einer dem den des es er sie wir ihr ich was welche welcher wer wann wo warum wie wenn im auf an am bei für von mit als zu "
           "zum und oder aber nicht kein keine ist sind war hat wird nach vor "
           "le la les un une du ce cette ces il elle ils nous vous on que quel quelle qui quand où pourquoi comment si dans sur par pour avec et ou mais est "
           "el los las una este esta estos qué cuál quién cuándo dónde cómo en por para con y o pero son se su lo")
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
_WORD_END = r"(?![\p{L}\p{M}])"
_NUMBER_WORD = rf"(?<![\p{{L}}\p{{M}}])(?iu:{'|'.join(dict.fromkeys(NUMBER_WORDS.split()))}){_WORD_END}"
_OPENER = "|".join(w.capitalize() for w in dict.fromkeys(OPENERS.split()))
_NAME = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?=\p{{Lu}})(?!(?:{_OPENER}){_WORD_END})\p{{Lu}}[\p{{Ll}}\p{{M}}]+{_WORD_END}"


def template_words(text: Column) -> Column:
    """The template of a text as an array of words and placeholders."""
    t = F.regexp_replace(text, _NUMBER_WORD, f" {NUM} ")
    t = F.regexp_replace(t, _NAME, f" {NAME} ")
    t = F.regexp_replace(t, _NUMBER, f" {NUM} ")
    t = F.regexp_replace(t, f"(?<={NUM} {{1,3}})(?:{'|'.join(UNITS.split())})(?![\\p{{L}}\\p{{M}}])", f" {UNIT} ")
    return F.filter(F.split(F.lower(t), f"[^\\p{{L}}\\p{{M}}{NUM}{NAME}{UNIT}]+"), lambda w: w != "")


def raw_words(text: Column) -> Column:
    """The words behind :func:`template_words`, place by place."""
    return F.regexp_extract_all(text, F.lit(_NUMBER + r"|[\p{L}\p{M}]+"), F.lit(0))


def windows(words: Column, size: int, stride: int = 1) -> Column:
    """Hashes of the windows of ``size`` words that start at every ``stride``-th word."""
    last = F.size(words) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, size)))


def lead_windows(words: Column, raw: Column, size: int) -> Column:
    """:func:`windows`, as (place, hash), and those that begin with a name or unit also with the word itself."""
    plain = F.transform(windows(words, size), lambda h, i: F.struct(i.alias("place"), h.alias("hash")))
    open_ = F.filter(F.transform(plain, lambda w: w["place"]), lambda i: F.element_at(words, i + 1).isin(NAME, UNIT))
    word = lambda i: F.array(F.lower(F.try_element_at(raw, i + 1)))
    return F.concat(plain, F.transform(open_, lambda i: F.struct(i.alias("place"), F.xxhash64(F.concat(word(i), F.slice(words, i + 2, size - 1))).alias("hash"))))


def short_leaks(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of :func:`leaking_rows` for items below ``LEAST_WORDS`` template words: exact runs of raw words."""
    low = lambda c: F.transform(raw_words(F.col(c)), F.lower)
    asked = items.withColumn("w", low("text")).withColumn("n", F.size("w")).filter("n > 0").select(
        "item_id", "n", F.xxhash64("w").alias("hash"), ((F.col("n") == 1) & ~F.concat_ws("", "w").rlike(_UNSPACED)).alias("alone"))
    asked = written(asked, "leak-short")
    sizes = sorted(r["n"] for r in asked.select("n").distinct().collect())
    if not sizes:
        return None
    words = rows.select("doc_id", "print", low("text").alias("w"))
    none = F.array().cast("array<struct<n:int,hash:bigint>>")

    def sized(n):
        return F.coalesce(F.transform(windows(F.col("w"), n), lambda h: F.struct(F.lit(n).alias("n"), h.alias("hash"))), none)

    runs = words.select("doc_id", "print", F.size("w").alias("size"), F.explode(F.array_distinct(F.concat(*[sized(n) for n in sizes]))).alias("r"))
    found = runs.select("doc_id", "print", "size", "r.n", "r.hash").join(_maybe_broadcast(asked, asked.count()), ["n", "hash"])
    # rows with equal id and text give one result
    return found.filter("not alone or size = 1").select("doc_id", "item_id", "print").distinct().selectExpr(
        "doc_id", "item_id", "1 as n_windows", "1L as n_found", "1D as coverage", "0L as n_slots", "0L as n_changed", "true as consistent",
        "true as leaked", "print")


def longest_run(n_windows: Column, window: int, cover: float) -> Column:
    """Windows in a row that are found at least in any document that reaches ``cover`` of an item's windows.

    A word put in takes ``window - 1`` windows away, any other change more: that bounds the number of runs.
    """
    need = F.greatest(F.ceil(n_windows * cover), F.lit(1))
    return F.ceil(need / (1 + F.floor((n_windows - need) / max(window - 1, 1))))


def shift_runs(ats: Column, shift: Column) -> Column:
    """Sorted places of windows of an item at one shift as runs (last, first, shift)."""
    has = lambda k: lambda a: F.array_contains(ats, a + k)
    ends = F.arrays_zip(F.filter(ats, lambda a: ~has(1)(a)).alias("last"), F.filter(ats, lambda a: ~has(-1)(a)).alias("first"))
    return F.transform(ends, lambda e: F.struct(e["last"].alias("last"), e["first"].alias("first"), shift.alias("shift")))


_RUNS = "array<struct<last:int,first:int,shift:int>>"


def best_chain(runs: Column) -> Column:
    """(n, runs) of the chain with the most windows whose places increase in the item and in the document.

    Of these the one that changes its shift least, then the earliest in the document. A run that overlaps the one
    before it gives its windows after that.
    """
    chain = f"struct<n:int,back:int,early:int,runs:{_RUNS}>"

    def extended(c, r):
        end = F.element_at(c["runs"], -1)
        first = F.greatest(r["first"], end["last"] + 1 + F.greatest(F.lit(0), end["shift"] - r["shift"]))
        rest = F.struct(r["last"].alias("last"), first.alias("first"), r["shift"].alias("shift"))
        longer = F.struct((c["n"] + r["last"] - first + 1).alias("n"), (c["back"] - (end["shift"] != r["shift"]).cast("int")).alias("back"),
                          c["early"].alias("early"), F.concat(c["runs"], F.array(rest)).alias("runs"))
        return F.when(first <= r["last"], longer)

    def add(chains, r):
        alone = F.struct((r["last"] - r["first"] + 1).alias("n"), F.lit(0).alias("back"), (-r["first"] - r["shift"]).alias("early"), F.array(r).alias("runs"))
        longest = F.array_max(F.concat(F.array(alone), F.transform(chains, lambda c: extended(c, r))).cast(f"array<{chain}>"))
        return F.concat(chains, F.array(longest))

    chains = F.aggregate(F.array_sort(runs).cast(_RUNS), F.array().cast(f"array<{chain}>"), add)
    return F.transform(F.array(F.array_max(chains)), lambda c: F.struct(c["n"].alias("n"), c["runs"].alias("runs")))[0]


def _value(t: Column, raw: Column, i: Column) -> Column:
    """All words of the value that the placeholder at ``i`` is part of: neighbours with the same placeholder."""
    other = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda j: F.try_element_at(t, j + 1) != F.try_element_at(t, i + 1))
    low = F.coalesce(F.array_max(F.filter(other, lambda j: j < i)), F.lit(-1)) + 1
    high = F.coalesce(F.array_min(F.filter(other, lambda j: j > i)), F.size(t)) - 1
    return F.lower(F.array_join(F.slice(raw, low + 1, high - low + 1), " "))


def judged(cover: float):
    """(leaked, n, ...) of a chain: its slots' values, each at the shift of its own windows, map one to one.

    Values are read word by word, or else, where a run ends inside the item at a slot, with all their words (a value may
    have more words than the item's: its other words are then beside the run).
    """
    def of(c):
        at = lambda words, i: F.lower(F.try_element_at(words, (i + 1).cast("int")))
        is_slot = lambda p: F.element_at("item_t", (p + 1).cast("int")).isin(NUM, NAME, UNIT)
        edge = lambda p, r: ((p == r["first"]) & (p > 0)) | ((p == r["last"] + F.col("size") - 1) & (p < F.size("item_t") - 1))
        slots = F.flatten(F.transform(c["runs"], lambda r: F.transform(
            F.filter(F.sequence(r["first"], r["last"] + F.col("size") - 1), is_slot),
            lambda p: F.struct(p.alias("p"), (p + r["shift"]).alias("q"), edge(p, r).alias("edge")))))
        words = lambda s: F.struct(at(F.col("item_raw"), s["p"]).alias("item"), at(F.col("doc_raw"), s["q"]).alias("doc"))
        whole = lambda s: F.when(s["edge"], F.struct(
            _value(F.col("item_t"), F.col("item_raw"), s["p"]).alias("item"), _value(F.col("doc_t"), F.col("doc_raw"), s["q"]).alias("doc"))).otherwise(words(s))
        distinct = lambda x, name: F.size(F.array_distinct(F.transform(x, lambda v: v[name])))
        fits = lambda m: (F.size(m) == distinct(m, "item")) & (F.size(m) == distinct(m, "doc"))
        single, full = F.array_distinct(F.transform(slots, words)), F.array_distinct(F.transform(slots, whole))
        consistent = fits(single) | fits(full)
        mapped = F.when(fits(single) | ~fits(full), single).otherwise(full)
        return F.struct((consistent & (c["n"] / F.col("n_windows") >= cover)).alias("leaked"), c["n"].alias("n"), consistent.alias("consistent"),
                        distinct(slots, "p").alias("n_slots"), F.size(F.filter(mapped, lambda v: v["item"] != v["doc"])).alias("n_changed"))
    return of


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WINDOWS else df


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, stride: int = STRIDE, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, coverage, n_slots, n_changed, consistent, leaked) of every pair found."""
    return leaking_rows(docs, items, window, stride, cover).drop("print")


def leaking_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW, stride: int = STRIDE, cover: float = COVER) -> DataFrame:
    """The columns of :func:`leaks` and ``print``, the fingerprint of the document's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = written(items.select("item_id", text.alias("text")).distinct().select(
        "item_id", "text", F.xxhash64("text").alias("item_print"), template_words(F.col("text")).alias("t"), raw_words(F.col("text")).alias("raw")).withColumn(
        # a shorter item is one window
        "size", F.when(F.size("t") >= window + stride - 1, F.lit(window)).otherwise(F.size("t"))), "leak-items")
    rows = docs.select("doc_id", text.alias("text"), fingerprint().alias("print"))
    short_found = short_leaks(rows, items.filter(F.col("size") < LEAST_WORDS).select("item_id", "text"))
    items = items.filter(F.col("size") >= LEAST_WORDS).drop("text")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    item_windows = None
    for n in sizes:
        cut = windows(F.col("t"), n)
        open_ = F.element_at("t", 1).isin(NAME, UNIT)
        word = F.xxhash64(F.concat(F.array(F.lower(F.element_at("raw", 1))), F.slice("t", 2, n - 1)))
        read = F.transform(cut, lambda h, i: F.struct(i.alias("at"), h.alias("hash")))
        both = F.when(open_, F.concat(read, F.array(F.struct(F.lit(0).alias("at"), word.alias("hash"))))).otherwise(read)
        part = items.filter(F.col("size") == n).select(
            "item_id", "item_print", "size", F.size(cut).alias("n_windows"), F.explode(both).alias("w")).select(
            "item_id", "item_print", "size", "n_windows", "w.at", "w.hash")
        item_windows = part if item_windows is None else item_windows.union(part)
    schema = ("doc_id long, item_id long, n_windows int, n_found long, coverage double, n_slots long, n_changed long, "
              "consistent boolean, leaked boolean, print long")
    if item_windows is None:
        return short_found or docs.sparkSession.createDataFrame([], schema)
    item_windows = written(item_windows, "leak-windows")
    n_rows = item_windows.count()

    # 1. documents with a hit
    probe = rows.select("doc_id", "print", template_words(F.col("text")).alias("t"))
    # short items are windows of a size of their own, probed at every place; an item of exactly a window's words too
    short = {r["size"] for r in items.filter(F.size("t") == F.col("size")).select("size").distinct().collect()}
    none = F.array().cast("array<struct<size:int,hash:bigint>>")
    runs = item_windows.filter((F.col("size") == window) & (F.col("n_windows") > 1)).agg(F.min(longest_run(F.col("n_windows"), window, cover)).alias("n")).first()
    stride = min(stride, runs["n"] or stride)

    def sized(n):
        tagged = F.transform(windows(F.col("t"), n, 1 if n in short else stride), lambda h: F.struct(F.lit(n).alias("size"), h.alias("hash")))
        return F.coalesce(tagged, none)

    probes = F.concat(*[sized(n) for n in sizes])
    # an item's first word as the placeholder that it may be in a document
    first = items.filter(F.element_at("raw", 1).rlike(r"^\p{Lu}[\p{Ll}\p{M}]+$")).withColumn("as", F.lit(NAME)).unionByName(
        items.filter(F.element_at("t", 1).isin(*UNITS.split())).withColumn("as", F.lit(UNIT)))
    first = first.select("size", F.xxhash64(F.concat(F.array("as"), F.expr("slice(t, 2, size - 1)"))).alias("hash"))
    asked = item_windows.select("size", "hash").union(first).distinct()
    hit = probe.select("doc_id", "print", F.explode(probes).alias("w")).select("doc_id", "print", "w.size", "w.hash").join(
        _maybe_broadcast(asked, n_rows), ["size", "hash"], "left_semi").select(F.col("doc_id").alias("k1"), F.col("print").alias("k2")).distinct()

    # 2. all windows of those documents against the items
    near = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("print") == F.col("k2"))).select(
        "doc_id", "print", template_words(F.col("text")).alias("t"), raw_words(F.col("text")).alias("raw"))
    near = written(near.dropDuplicates(["doc_id", "print"]), "leak-near")
    found = None
    for n in sizes:
        part = near.select("doc_id", "print", F.lit(n).alias("size"), F.explode(lead_windows(F.col("t"), F.col("raw"), n)).alias("w")).select(
            "doc_id", "print", "size", "w.place", "w.hash")
        found = part if found is None else found.union(part)
    found = found.join(_maybe_broadcast(item_windows, n_rows), ["size", "hash"])
    pair = ["doc_id", "print", "item_id", "item_print"]
    # runs of windows at one shift (place - at), and their best chain or the single shift that most windows share
    aligned = found.withColumn("shift", F.col("place") - F.col("at")).groupBy(*pair, "size", "n_windows", "shift").agg(
        F.array_sort(F.collect_set("at")).alias("ats"))
    best = aligned.groupBy(*pair, "size", "n_windows").agg(
        F.flatten(F.collect_list(shift_runs(F.col("ats"), F.col("shift")))).alias("runs"),
        F.max(F.struct(F.size("ats").alias("n"), (-F.col("shift")).alias("back"), shift_runs(F.col("ats"), F.col("shift")).alias("runs"))).alias("b"))
    best = best.withColumn("chains", F.array(F.struct(F.col("b.n").alias("n"), F.col("b.runs").alias("runs")), best_chain(F.col("runs")))).drop("runs", "b")
    full = best.alias("b0").join(near.alias("n0"), F.expr("b0.doc_id <=> n0.doc_id and b0.print = n0.print")).select(
        "b0.*", F.col("n0.t").alias("doc_t"), F.col("n0.raw").alias("doc_raw"))
    full = full.alias("f0").join(items.select("item_id", "item_print", "t", "raw").alias("i0"),
                                 F.expr("f0.item_id <=> i0.item_id and f0.item_print = i0.item_print")).select(
        "f0.*", F.col("i0.t").alias("item_t"), F.col("i0.raw").alias("item_raw"))
    result = F.array_max(F.transform("chains", judged(cover)))
    out = full.withColumn("r", result).select(
        "doc_id", "item_id", "n_windows", F.col("r.n").cast("long").alias("n_found"), (F.col("r.n") / F.col("n_windows")).alias("coverage"),
        F.col("r.n_slots").cast("long").alias("n_slots"), F.col("r.n_changed").cast("long").alias("n_changed"), "r.consistent", "r.leaked", "print")
    return out.unionByName(short_found) if short_found else out


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
