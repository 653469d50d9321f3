"""Secret scan over a trigram inverted index, with DataFrame functions only.

Every rule is a regular expression. From its parse tree follows a Boolean query of trigrams: alternatives of
literal runs that any match must contain (any alternative, all of its trigrams). The index holds, for the trigrams
that some rule asks for, the documents whose lower-cased text contains them; a rule's candidates are the documents
in the postings of all trigrams of an alternative, found by one aggregation. Candidates are verified with the rule
itself; a rule with an alternative without trigrams (a bare character class) scans every text.

Spans are code points, end exclusive, leftmost non-overlapping per rule, ``kind:start:end`` in order of start, then
kind. Odd input: a null text is empty and has no spans (empty strings); null ids are matched null-safely; rows with
equal id and text share postings and each keep their row.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre, _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression and, for matches that need one, a group with a least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules in listing order, then the added ones.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# A key in PEM form: up to its END line; where that is missing header lines, long base64 runs and a last short one
# (white space, escaped line ends, quotes and comment marks stand between them).
_GAP = r"""(?:[\x20\x09-\x0D"'+,>#*|]|\\[nrt])"""
_PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|"
        rf"(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\n\r\\]*+)*+(?:(?:{_GAP}*+[A-Za-z0-9+/]{{20,}}+={{0,2}})++"
        rf"(?:{_GAP}++[A-Za-z0-9+/]{{1,19}}+(?:={{1,2}}|(?![^\n\r])))?)?)")
MORE_RULES = (
    Rule("private_key", _PEM),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

_MOST_ALTERNATIVES = 64


def _runs(tree) -> list[list[str]]:
    """Alternatives of literal runs of a parsed expression; an empty string ends a run."""
    alts: list[list[str]] = [[""]]

    def append(options: list[list[str]]):
        # join the last run of each alternative with the first of each option
        return [a[:-1] + [a[-1] + o[0]] + o[1:] for a in alts for o in options]

    gap = [["", ""]]
    for op, arg in tree:
        if op is sre.LITERAL:
            options = [[chr(arg).lower()]]
        elif op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
            options = [[chr(c).lower()] for _, c in arg]
        elif op is sre.SUBPATTERN:
            options = _runs(arg[-1])
        elif op is sre.BRANCH:
            options = [o for branch in arg[1] for o in _runs(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            if (least, most) == (0, 1):
                options = [[""]] + _runs(inner)
            elif least:
                options = [o + [""] if most != 1 else o for o in _runs(inner)]
                options = [o[:-1] + ["", o[-1]] if most != 1 else o for o in options]
            else:
                options = gap
        elif op is sre.AT:
            options = [[""]]
        else:
            options = gap
        if len(alts) * len(options) > _MOST_ALTERNATIVES:
            options = gap
        alts = append(options)
    return alts


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams, or None if a match need not contain any."""
    out = set()
    for runs in _runs(sre_parser.parse(pattern)):
        grams = frozenset(r[i:i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        out.add(grams)
    return sorted(out, key=sorted)


def posting_index(rows: DataFrame, key: list[str], grams: list[str]) -> DataFrame:
    """(gram, key...) of the documents whose lower-cased text contains each trigram."""
    low = rows.select(*key, F.lower("text").alias("low"))
    asked = F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams])
    return low.select(*key, F.explode(F.array_compact(asked)).alias("gram"))


def candidates(rows: DataFrame, key: list[str], rules) -> DataFrame:
    """(key..., rules): the rules whose trigram query a document meets, by intersecting postings."""
    spark = rows.sparkSession
    queries = [(r.kind, i, g, len(alt)) for r in rules for i, alt in enumerate(trigram_query(r.pattern) or ()) for g in sorted(alt)]
    asked = spark.createDataFrame(queries, "kind string, alternative int, gram string, size int")
    index = posting_index(rows, key, sorted({q[2] for q in queries}))
    met = index.join(F.broadcast(asked), "gram").groupBy(*key, "kind", "alternative", "size").agg(F.count_distinct("gram").alias("n"))
    return met.filter("n = size").groupBy(*key).agg(F.collect_set("kind").alias("rules"))


#: Matches of a rule whose spans are added to one array at a time.
SPAN_BLOCK = 256


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule as array<struct<start, rank, end, kind>>."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("long"))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    found = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"),
                         F.transform(whole, lambda m: F.length(m).cast("long")).alias("size"),
                         F.transform(tested, lambda m: F.length(m) >= rule.least).alias("good"))
    span = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
    reach = lambda m: m["gap"] + m["size"]

    def add(acc, m):
        begin = acc["at"] + m["gap"]
        end = begin + m["size"]
        one = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(m["good"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def of_block(z):
        return F.aggregate(z["block"], F.struct(z["from"].alias("at"), F.array().cast(span).alias("out")), add, lambda a: a["out"])

    def placed(matches):
        # blocks of matches, so that no array grows by one match at a time over a whole text
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / SPAN_BLOCK).cast("int")), lambda k: F.slice(matches, k * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK)))
        return F.transform(F.array(blocks), offsets)[0]

    def offsets(blocks):
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, m: a + reach(m)))
        before = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        pairs = F.arrays_zip(blocks.alias("block"), F.slice(before, F.lit(1), F.size(blocks)).alias("from"))
        return F.flatten(F.transform(pairs, of_block))

    spans = F.transform(F.array(found), placed)[0]
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(span))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, base=BASE_RULES, more=MORE_RULES) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans`` (arrays of start, rank, end, kind in order)."""
    rules = (*base, *more)
    prefix = "_secret_"
    id_, print_, text = f"{prefix}id", f"{prefix}print", f"{prefix}text"
    rows = docs.withColumns({id_: F.col("doc_id"), text: F.coalesce(F.col("text").cast("string"), F.lit(""))}).withColumn(
        print_, F.xxhash64(text))
    slim = rows.select(id_, print_, F.col(text).alias("text"))
    found = candidates(slim, [id_, print_], rules).select(F.col(id_).alias(f"{prefix}k1"), F.col(print_).alias(f"{prefix}k2"), F.col("rules").alias(f"{prefix}rules"))
    both = rows.join(found, F.col(id_).eqNullSafe(F.col(f"{prefix}k1")) & (F.col(print_) == F.col(f"{prefix}k2")), "left").drop(f"{prefix}k1", f"{prefix}k2")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")

    def of(some, first):
        parts = [rule_spans(F.col(text), r, rank) if trigram_query(r.pattern) is None else
                 F.when(F.array_contains(f"{prefix}rules", r.kind), rule_spans(F.col(text), r, rank)).otherwise(none)
                 for rank, r in enumerate(some, first)]
        return F.array_sort(F.concat(*parts))

    out = both.withColumn("base_spans", of(base, 0))
    out = out.withColumn("all_spans", F.array_sort(F.concat("base_spans", of(more, len(base)))) if more else F.col("base_spans"))
    return out.drop(id_, print_, text, f"{prefix}rules")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the union of ``spans`` replaced by a mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc, s):
        fresh = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    tail = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, tail)).otherwise(text)


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""
    out = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(r.kind) for r in BASE_RULES],
                      F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))
