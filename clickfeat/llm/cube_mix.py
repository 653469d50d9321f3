"""Mix sources to target weights by cube-method balanced sampling.

Each source's target is its share of the mix. A document is taken ``floor(f)`` times
(f = target / words of the source) and once more with probability ``frac(f)``. The
extra copies are drawn by the cube method: inclusion probabilities move through the
null space of two balancing constraints (documents and words), so that both totals
stay where they are until at most two documents of a block are left undecided.

Flights run in blocks of bounded size dealt by a hash (any source, however large, is
many blocks); undecided documents of all blocks of a source meet in the next round,
two out of each block, until one block per source is left. There the two undecided and
``LANDED`` documents kept back are landed together: the rounding nearest to both totals. Draws are seeded by the block, so a rerun
of a task gives the same sample.

Odd input: a null or wordless text has size 0 and is taken 0 words; a null source is a
source of its own, last in order; repeated rows are units of their own; a source
without words has target 0.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import documents, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Documents of one flight.
BLOCK = 4096
#: Documents of a source that the landing decides besides the flight's last two.
LANDED = 10

WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Shares of ``share * total`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    total = share * sum(sizes)
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        whole = sum(weights[i] for i in free)
        full = [i for i in free if total * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = total * weights[i] / whole
            break
        for i in full:
            out[i] = most * sizes[i]
        total -= sum(out[i] for i in full)
        free = [i for i in free if i not in full]
    return out


def _move(p, u, rng):
    """One step of the flight: along u or against it, to the nearest face, keeping expectations."""
    up = min(((1 - a) / b if b > 0 else a / -b) for a, b in zip(p, u) if b)
    down = min((a / b if b > 0 else (1 - a) / -b) for a, b in zip(p, u) if b)
    step = up if rng.random() * (up + down) < down else -down
    return [min(1.0, max(0.0, a + step * b)) for a, b in zip(p, u)]


def _snap(p):
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def flight(sizes, probs, rng):
    """Move probabilities until at most two units are undecided; documents and words stay balanced."""
    probs = list(probs)
    live: list[int] = []
    for i, p in enumerate(probs):
        if 0.0 < p < 1.0:
            live.append(i)
        while len(live) == 3:
            a, b, c = (sizes[j] for j in live)
            u = (c - b, a - c, b - a)
            if not any(u):
                u = (1, -1, 0)
            for j, q in zip(live, _move([probs[j] for j in live], u, rng)):
                probs[j] = _snap(q)
            live = [j for j in live if 0.0 < probs[j] < 1.0]
    return probs


def landing(sizes, probs):
    """Decide the few units left: of all roundings whose document total is nearest (within one), the one
    whose word total is nearest to the expected ones."""
    probs = np.array(probs, float)
    live = np.flatnonzero((probs > 0) & (probs < 1))
    if len(live):
        p, s = probs[live], np.array(sizes, float)[live]
        pick = (np.arange(1 << len(live))[:, None] >> np.arange(len(live))) & 1
        units, words = np.abs(pick.sum(1) - p.sum()), np.abs(pick @ s - p @ s)
        words[units > units.min() + 1] = np.inf
        probs[live] = pick[np.argmin(words)]
    return probs.tolist()


def _fly(seed: int, land: bool):
    def run(key, table):
        rows = sorted(zip(table.column("unit").to_pylist(), table.column("size").to_pylist(), table.column("p").to_pylist()))
        name = repr((seed, land, [k.as_py() for k in key])).encode()
        rng = random.Random(hashlib.sha256(name).digest())
        rng.shuffle(rows)
        sizes, probs = [r[1] for r in rows], [r[2] for r in rows]
        fly = max(0, len(rows) - LANDED) if land else len(rows)
        probs = flight(sizes[:fly], probs[:fly], rng) + probs[fly:]
        if land:
            probs = landing(sizes, probs)
        return pa.table({"rank": pa.array([key[0].as_py()] * len(rows), pa.int64()), "unit": pa.array([r[0] for r in rows], pa.string()),
                         "size": pa.array(sizes, pa.int64()), "p": pa.array(probs, pa.float64())})
    return run


_UNITS = "rank long, unit string, size long, p double"


def balanced_draw(units: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(rank, unit, size, p) with p in {0, 1}: a sample of each rank, balanced on units and sizes."""
    done, level = None, 0
    while True:
        most = units.groupBy("rank").count().agg(F.max("count")).first()[0] or 0
        last = most <= block
        parts = units.groupBy("rank").agg(F.ceil(F.count("*") / block).alias("parts"))
        dealt = units.join(parts, "rank").withColumn("part", F.pmod(F.xxhash64("unit", F.lit(seed + level)), F.col("parts")))
        flown = written(dealt.groupBy("rank", "part").applyInArrow(_fly(seed + level, last), _UNITS), "mix-flight")
        settled = flown if last else flown.filter("p = 0 or p = 1")
        done = settled if done is None else done.union(settled)
        if last:
            return done
        units, level = flown.filter("p > 0 and p < 1"), level + 1


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
                block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, fingerprint."""
    spark = docs.sparkSession
    base = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"),
                               F.xxhash64("text").alias("fingerprint")), "mix-sizes")
    # one row per source: the table of sources is the recipe, not data
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["source_size"] for r in totals]
    targets = source_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    recipe = spark.createDataFrame([(i, r["source"], s, t) for i, (r, s, t) in enumerate(zip(totals, sizes, targets))],
                                   "rank long, source string, source_size long, target double")
    joined = base.join(F.broadcast(recipe), base["source"].eqNullSafe(recipe["source"])).drop(recipe["source"])
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    frac = F.col("f") - F.floor("f")
    # repeated rows are told apart by a number within their equal rows
    same = Window.partitionBy("doc_id", "source", "size", "fingerprint").orderBy(F.lit(0))
    rows = joined.withColumn("f", f).withColumn("copy", F.row_number().over(same)).withColumn(
        "unit", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "fingerprint", "copy"))
    units = rows.filter((F.col("size") > 0) & (frac > 0)).select("rank", "unit", "size", frac.alias("p"))
    drawn = balanced_draw(units, block, seed).select("rank", "unit", F.col("p").alias("more"))
    return rows.join(drawn, ["rank", "unit"], "left").select(
        "doc_id", "source", "size", "source_size", "target",
        ((F.floor("f") + F.coalesce("more", F.lit(0.0))) * F.col("size")).cast("long").alias("taken"), "fingerprint")


def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
