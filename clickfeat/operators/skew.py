"""Key profile and the per-combination strategy choice.

Every feature family is keyed by a combination of id columns. Two physical
plans compute it exactly:

* ``window`` - the rows are hash-partitioned once by a *root* of the
  combination (one to three of its keys) and every window of every combination
  under that root runs in that one partitioning (one exchange per root, not per
  combination). Safe only when no group of the root holds too many rows. Few roots
  are chosen to serve all combinations; sets of keys are counted only where single
  keys are hot or thin.
* ``second`` - the rows are first reduced to one row per (keys, second) with a
  map-side partial aggregate; windows run on that table, whose groups are
  bounded by the number of distinct seconds in the data, however hot a key is;
  the result is attached back with an equi-join on (keys, second). The join is a
  broadcast when the reduced table has a proven row bound under the limit,
  otherwise a shuffle join (AQE splits skewed partitions).

The profile behind the choice is one aggregation job returning one row per id
column (bounded by the number of id columns) - nothing data-sized reaches the
driver.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F, types as T

from ..schema import ID_COLUMNS, SECONDS

ROOT_KEYS = 3                      # keys of a root at most
DEFAULT_HOT_ROWS = 2_000_000       # a root value with more rows than this is "hot"
DEFAULT_BROADCAST_ROWS = 1_000_000  # proven row bound under which a reduced table is broadcast


@dataclass
class KeyProfile:
    total_rows: int
    distinct: dict[str, int]
    max_group: dict[str, int]
    min_second: int | None
    max_second: int | None
    hot_rows: int = DEFAULT_HOT_ROWS
    broadcast_rows: int = DEFAULT_BROADCAST_ROWS
    min_root_distinct: int = 1
    forced: str | None = None  # "window" / "second" to force one plan (tests)
    # exact (distinct groups, rows of the largest group) of sets of two or more keys, where they were counted
    sets: dict[tuple[str, ...], tuple[int, int]] = field(default_factory=dict)

    @property
    def span_seconds(self) -> int:
        if self.min_second is None or self.max_second is None:
            return 0
        return int(self.max_second) - int(self.min_second) + 1

    def good_root(self, key: str) -> bool:
        """A key may root the window plan when none of its values holds more than
        ``hot_rows`` rows and it has enough values to keep the tasks busy (the
        second test is moot when the whole input is under the hot bound)."""
        if key not in self.max_group:
            return False
        if self.max_group[key] > self.hot_rows:
            return False
        return self.total_rows <= self.hot_rows or self.distinct[key] >= self.min_root_distinct

    def root_for(self, combo: tuple[str, ...]) -> str | None:
        """Root key for the window plan, or None when the combination needs the second plan.
        Among the good keys of the combination the one with most values wins
        (parallelism), ties by the fixed key order."""
        if self.forced == "second":
            return None
        if self.forced == "window":
            return combo[0]
        order = {k: i for i, k in enumerate(ID_COLUMNS)}
        good = [k for k in combo if self.good_root(k)]
        if not good:
            return None
        return min(good, key=lambda k: (-self.distinct[k], order.get(k, len(order))))

    def good_set(self, keys: tuple[str, ...]) -> bool:
        """As :meth:`good_root` for a set of keys whose groups were counted."""
        if len(keys) == 1:
            return self.good_root(keys[0])
        if keys not in self.sets:
            return False
        groups, largest = self.sets[keys]
        return largest <= self.hot_rows and (self.total_rows <= self.hot_rows or groups >= self.min_root_distinct)

    def uncounted_sets(self, combos, most: int = ROOT_KEYS) -> list[tuple[str, ...]]:
        """Key sets worth counting: of two to ``most`` keys, none of which is a safe root, inside some combination that has no
        safe key."""
        if self.forced or not self.distinct:
            return []
        out = {s for c in combos if not any(self.good_root(k) for k in c)
               for n in range(2, min(most, len(c)) + 1) for s in itertools.combinations(c, n)}
        return sorted(out - set(self.sets), key=lambda s: (len(s), s))

    def roots(self, combos) -> dict[tuple[str, ...], tuple[str, ...] | None]:
        """A root for every combination (None: the reduced plan), so that few roots serve all of them.

        Rows spread by a safe key set are clustered for every combination that holds it. Greedily the safe set that serves most
        of the combinations still without a root becomes one (fewer keys, then more groups first); in the end
        each combination takes that root within it that has most groups.
        """
        combos = list(dict.fromkeys(combos))
        if self.forced or not self.distinct:
            return {c: None if (k := self.root_for(c)) is None else (k,) for c in combos}
        safe = [s for s in {*((k,) for c in combos for k in c), *self.sets} if self.good_set(s)]
        groups = lambda s: self.distinct[s[0]] if len(s) == 1 else self.sets[s][0]
        chosen, left = [], set(combos)
        while left:
            served = {s: sum(set(s) <= set(c) for c in left) for s in safe}
            best = max((s for s in safe if served[s]), key=lambda s: (served[s], -len(s), groups(s), s), default=None)
            if best is None:
                break
            chosen.append(best)
            left = {c for c in left if not set(best) <= set(c)}
        return {c: max((s for s in chosen if set(s) <= set(c)), key=lambda s: (groups(s), s), default=None) for c in combos}

    def group_bound(self, combo: tuple[str, ...], with_seconds: bool = False) -> int:
        """Proven upper bound on the number of distinct groups of ``combo``."""
        if combo in self.sets:
            bound = max(1, self.sets[combo][0])
        else:
            bound = 1
            for k in combo:
                bound *= max(1, self.distinct.get(k, self.total_rows))
        if with_seconds:
            bound *= max(1, self.span_seconds)
        return min(bound, self.total_rows)

    def can_broadcast(self, combo: tuple[str, ...], with_seconds: bool = False) -> bool:
        return self.group_bound(combo, with_seconds) <= self.broadcast_rows


def profile_keys(df: DataFrame, keys=ID_COLUMNS, time_col: str = SECONDS, *,
                 hot_rows: int | None = None, broadcast_rows: int | None = None,
                 min_root_distinct: int | None = None, forced: str | None = None) -> KeyProfile:
    """Per id column: number of distinct values and rows of its largest value.

    One job: the columns are stacked into (key, value) pairs, counted per pair
    with a map-side partial aggregate, then reduced to one row per key.
    """
    keys = tuple(keys)
    spark = df.sparkSession
    integral = all(isinstance(df.schema[k].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
                   for k in keys)
    vtype = "long" if integral else "string"  # exact either way; long is cheaper to hash
    stacked = df.select(
        F.col(time_col).cast("long").alias("_sec"),
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("_key"), F.col(k).cast(vtype).alias("_val")) for k in keys
        ])).alias("_kv"),
    )
    per_value = stacked.groupBy(F.col("_kv._key").alias("_key"), F.col("_kv._val").alias("_val")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_sec").alias("_lo"), F.max("_sec").alias("_hi"))
    rows = per_value.groupBy("_key").agg(
        F.count(F.lit(1)).alias("distinct"), F.max("_n").alias("max_group"),
        F.sum("_n").alias("rows"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).collect()
    distinct = {r["_key"]: int(r["distinct"]) for r in rows}
    max_group = {r["_key"]: int(r["max_group"]) for r in rows}
    total = int(rows[0]["rows"]) if rows else 0
    lo = min((r["lo"] for r in rows if r["lo"] is not None), default=None)
    hi = max((r["hi"] for r in rows if r["hi"] is not None), default=None)
    if min_root_distinct is None:
        min_root_distinct = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return KeyProfile(
        total_rows=total, distinct=distinct, max_group=max_group, min_second=lo, max_second=hi,
        hot_rows=DEFAULT_HOT_ROWS if hot_rows is None else hot_rows,
        broadcast_rows=DEFAULT_BROADCAST_ROWS if broadcast_rows is None else broadcast_rows,
        min_root_distinct=min_root_distinct, forced=forced)


def profile_key_sets(df: DataFrame, profile: KeyProfile, combos) -> KeyProfile:
    """``profile`` with the exact groups of the key sets that could root ``combos`` where no single key can.

    One job, and only if there are such sets: rows collapse to id tuples (map-side), tuples to the groups of all sets
    (``GROUPING SETS``), these to one row per set.
    """
    wanted = profile.uncounted_sets(combos)
    if not wanted:
        return profile
    keys = sorted({k for s in wanted for k in s})
    tuples = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    number = F.grouping_id(*keys)  # a bit per key, 1 where the set leaves it out
    groups = tuples.groupingSets([[F.col(k) for k in s] for s in wanted], *keys).agg(F.sum("__n").alias("__n"), number.alias("__set"))
    rows = groups.groupBy("__set").agg(F.count(F.lit(1)).alias("groups"), F.max("__n").alias("largest")).collect()  # a row per set
    named = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s): s for s in wanted}
    return replace(profile, sets={**profile.sets, **{named[r["__set"]]: (int(r["groups"]), int(r["largest"])) for r in rows}})


def forced_profile(plan: str, broadcast: bool = False) -> KeyProfile:
    """A profile that skips the statistics job and forces one plan (tests,
    benchmarks); ``broadcast`` declares every reduced table small."""
    if plan not in ("window", "second"):
        raise ValueError("plan must be 'window' or 'second'")
    return KeyProfile(total_rows=1 if broadcast else 1 << 62, distinct={}, max_group={}, min_second=None,
                      max_second=None, forced=plan)


def maybe_broadcast(small: DataFrame, profile: KeyProfile, combo, with_seconds: bool) -> DataFrame:
    """Broadcast only under a proven row bound; beyond it leave the join to a shuffle."""
    return F.broadcast(small) if profile.can_broadcast(tuple(combo), with_seconds) else small
