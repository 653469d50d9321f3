"""Shared planning for features keyed by a combination of id columns.

A family (gaps, range counts, group counts, unique counts) describes each
combination's output twice, once per physical plan of ``skew.py``:

* ``window`` - window expressions over the rows, valid on rows that are
  hash-partitioned by any key of the combination. They come in three kinds by
  the order they need: ``ordered`` (time, row id), ``ranged`` (time) and
  ``plain`` (none), plus ``flags``: key sets whose "first row of the group"
  marker the expressions read (unique counts);
* ``apply_second(df, base)`` - the reduced (keys, second) or (keys) table, built
  from the input rows ``base`` (never from the growing ``df``, so each join adds
  one small subtree to the plan), joined back onto ``df``.

* ``sliced`` (where a family has it) - the neighbour of a row inside a slice of time, and which edge of the group's
  other slices stands in where the slice ends. Combinations with few, large groups share one exchange by time; the edges
  are one row per group and slice, under a proven bound.

A per-group statistic whose (keys) table has a proven row bound under the
broadcast limit skips the windows: hash aggregate, broadcast hash join, no
sort and no shuffle of the rows.

``add_keyed_features`` lays out one plan for any mix of families: the
combinations that must go the reduced way first (their joins carry the fewest
columns), then one repartition per root with every window of every family on
it, so a root costs one exchange no matter how many features hang off it.
With several roots each root runs on its own narrow branch of the input and the
branches are joined back on the row id.
Inside a root the key sets are visited largest first and each key set's
windows go into one projection, so they share the sorts on (keys, ...):
about one sort per key set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import ROW_ID
from ..session import reliable_checkpoint
from .skew import KeyProfile, profile_key_sets, profile_keys

ROWS_PER_TASK = 4_000_000  # rows of one window task, from which the number of partitions follows
BROADCAST_TOTAL_ROWS = 4_000_000  # proven rows of all tables that one plan broadcasts, together
BUCKETS_PER_SLICE = 16  # cells of the time histogram that the slices are cut from
SLICE = "__slice"


@dataclass
class WindowPlan:
    ordered: list[tuple[str, Column]] = field(default_factory=list)
    ranged: list[tuple[str, Column]] = field(default_factory=list)
    plain: list[tuple[str, Column]] = field(default_factory=list)
    flags: list[tuple[str, ...]] = field(default_factory=list)


@dataclass
class SlicePlan:
    """Neighbours in time order (``time_col``, then ``order_col``): names of the features that look ahead and back, and the
    feature from its row's time and its neighbour's."""
    time_col: str
    order_col: str
    ahead: tuple[str, ...]
    back: tuple[str, ...]
    value: Callable[[Column, Column], Column]  # (earlier time, later time)


@dataclass
class KeyedFeature:
    combo: tuple[str, ...]
    names: tuple[str, ...]
    window_plan: Callable[[], WindowPlan]
    apply_second: Callable[[DataFrame, DataFrame, KeyProfile], DataFrame]
    # per-group statistics (counts, distinct counts) need no order: when their
    # table has a proven small bound, hash aggregate + broadcast join beats sorting.
    # ("count",) or ("unique", objectives); None for windowed families
    stat: tuple | None = None
    sliced: SlicePlan | None = None

    @property
    def group_stat(self) -> bool:
        return self.stat is not None


def has_row_ids(df: DataFrame) -> bool:
    """Has every row an id of its own?"""
    wrong = df.groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(ROW_ID).isNull()).limit(1)
    return not wrong.count()


def check_row_ids(df: DataFrame) -> None:
    """Raise unless every row has an id of its own: branches meet on it."""
    if not has_row_ids(df):
        raise ValueError(f"{ROW_ID} must be unique and not null")


def flag_name(keys: Sequence[str]) -> str:
    return "__first_" + "_".join(keys)


def first_row_flag(keys: Sequence[str], order_col: str = ROW_ID) -> Column:
    """1 on the first row (lowest row id) of each group of ``keys``, else 0."""
    w = Window.partitionBy(*keys)
    return F.when(F.min(order_col).over(w) == F.col(order_col), F.lit(1)).otherwise(F.lit(0))


def null_key_guard(keys: Sequence[str], value: Column) -> Column:
    """Rows with a null key get a null feature (a null key forms no group)."""
    cond = None
    for k in keys:
        c = F.col(k).isNull()
        cond = c if cond is None else (cond | c)
    return F.when(cond, F.lit(None)).otherwise(value)


def root_partitions(configured: int, profile: KeyProfile) -> int:
    """Partitions of a root's exchange: the session's, or more when the profiled rows ask for it."""
    rows = profile.total_rows if profile.distinct else 0  # forced profiles have no measured size
    return max(configured, math.ceil(rows / ROWS_PER_TASK))


def _window_root(out: DataFrame, root: tuple[str, ...], group: Sequence[KeyedFeature], profile: KeyProfile) -> DataFrame:
    plans = {}
    for f in group:
        plans.setdefault(f.combo, []).append(f.window_plan())
    keysets = set(plans)
    for ps in plans.values():
        for p in ps:
            keysets.update(tuple(s) for s in p.flags)
    flags_needed = {tuple(s) for ps in plans.values() for p in ps for s in p.flags}
    # an explicit count keeps AQE from folding a small input into one task: the
    # windows below are the expensive part and need the parallelism
    n = root_partitions(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), profile)
    out = out.repartition(n, *[F.col(k) for k in root])
    # largest key sets first: a unique count of K reads flags of K + one key.
    # One projection per key set: its windows share that key set's sort (one
    # projection holding many window specs is slower to plan and to run)
    for ks in sorted(keysets, key=lambda t: (-len(t), t)):
        ps = plans.get(ks, [])
        cols = [c.alias(n) for p in ps for n, c in p.ordered]
        cols += [c.alias(n) for p in ps for n, c in p.ranged]
        if ks in flags_needed:
            cols.append(first_row_flag(ks).alias(flag_name(ks)))
        cols += [c.alias(n) for p in ps for n, c in p.plain]
        if cols:
            out = out.select("*", *cols)
    return out.drop(*[flag_name(s) for s in flags_needed])


def time_slices(df: DataFrame, time_col: str, profile: KeyProfile, n: int) -> tuple[Column, DataFrame, int]:
    """(bucket of a row, the slice of every bucket, rows of the largest slice): about ``n`` slices of equal size in time order,
    a second never split, rows without time in a slice before all others. One job; the driver gets the histogram's cells."""
    cells = n * BUCKETS_PER_SLICE
    width = max(1, math.ceil(profile.span_seconds / cells))
    t = F.col(time_col).cast("long")
    at = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((t - F.lit(profile.min_second)) / F.lit(width))))
    bucket = F.when(t.isNull(), F.lit(-1)).otherwise(at).cast("int")
    hist = df.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("__bucket").collect()
    total, seen, of, sizes = sum(r["n"] for r in hist), 0, [], {}
    for r in hist:
        s = -1 if r["__bucket"] < 0 else seen * n // total
        of.append((r["__bucket"], s))
        sizes[s] = sizes.get(s, 0) + r["n"]
        seen += r["n"]
    return bucket, df.sparkSession.createDataFrame(of, f"__bucket int, {SLICE} int"), max(sizes.values(), default=0)


def sliceable(features: Sequence[KeyedFeature], roots, profile: KeyProfile, n: int) -> list[KeyedFeature]:
    """Features of combinations without a root of one key whose edges, a row per group and slice, stay under half of what a
    plan may broadcast; those with the fewest groups first."""
    if profile.forced or profile.min_second is None or profile.total_rows <= profile.hot_rows:
        return []
    out, held = [], 0
    able = [f for f in features if f.sliced and (roots[f.combo] is None or len(roots[f.combo]) > 1)]
    for f in sorted(able, key=lambda f: profile.group_bound(f.combo)):
        held += profile.group_bound(f.combo) * (n + 1)
        if held > BROADCAST_TOTAL_ROWS // 2 or (f.sliced.time_col, f.sliced.order_col) != (able[0].sliced.time_col, able[0].sliced.order_col):
            break
        out.append(f)
    return out


def _window_slices(df: DataFrame, features: Sequence[KeyedFeature], bucket: Column, slices: DataFrame, n: int) -> DataFrame:
    """Every feature from windows inside the slices of time (one exchange); where a slice ends, the nearest edge of the group's
    other slices is the neighbour."""
    time_col, order_col = features[0].sliced.time_col, features[0].sliced.order_col
    t, cols = F.col(time_col), list(df.columns)
    keys = sorted({k for f in features for k in f.combo})
    placed = df.withColumn("__bucket", bucket).join(F.broadcast(slices), "__bucket").drop("__bucket")
    # first and last second of every id tuple in every slice: all edges come from this table
    tuples = reliable_checkpoint(placed.groupBy(SLICE, *keys).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi")))
    out = placed.repartitionByRange(n, SLICE)
    for f in sorted(features, key=lambda f: (-len(f.combo), f.combo)):
        w = Window.partitionBy(SLICE, *f.combo).orderBy(time_col, order_col)
        out = out.select("*", *[F.lead(t).over(w).alias(c) for c in f.sliced.ahead], *[F.lag(t).over(w).alias(c) for c in f.sliced.back])
    for f in features:
        tag = "__e_" + "_".join(f.combo)
        named = {k: f"{tag}_{i}" for i, k in enumerate((SLICE, *f.combo))}
        w = Window.partitionBy(*f.combo).orderBy(SLICE)
        edges = (tuples.groupBy(SLICE, *f.combo).agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
                 .select(SLICE, *f.combo, F.lead("__lo").over(w).alias(f"{tag}_next"), F.lag("__hi").over(w).alias(f"{tag}_last")))
        edges = edges.withColumnsRenamed(named)
        same = None
        for k, e in named.items():
            same = (out[k] == edges[e]) if same is None else same & (out[k] == edges[e])
        new = {**{c: f.sliced.value(t, F.coalesce(c, F.col(f"{tag}_next"))) for c in f.sliced.ahead},
               **{c: f.sliced.value(F.coalesce(c, F.col(f"{tag}_last")), t) for c in f.sliced.back}}
        out = out.join(F.broadcast(edges), same, "left").select(*[new[c].alias(c) if c in new else out[c] for c in out.columns])
    return out.select(*cols, *[c for f in features for c in f.names])


TUPLE_RATIO = 0.5  # use the tuple table when distinct id tuples are at most this share of the rows


def tuple_table(df: DataFrame, stats: Sequence[KeyedFeature], profile: KeyProfile) -> DataFrame | None:
    """Distinct id tuples with their row count, when they are provably far fewer than rows.

    Every count and distinct count over the id columns is a function of these
    tuples: counts add up ``__n``, distinct counts count tuples. Reading them
    instead of the rows pays when tuples are few (many clicks per tuple). The
    decision costs no job: the product of the profiled distinct counts bounds the
    number of tuples, and only a bound under ``TUPLE_RATIO`` of the rows switches.
    """
    keys = sorted({k for f in stats for k in f.combo} | {x for f in stats if f.stat[0] == "unique" for x in f.stat[1]})
    if not all(k in profile.distinct for k in keys):
        return None
    bound = 1
    for k in keys:
        bound *= max(1, profile.distinct[k])
    if bound > TUPLE_RATIO * max(1, profile.total_rows):
        return None
    return reliable_checkpoint(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))


def add_keyed_features(df: DataFrame, features: Sequence[KeyedFeature], profile: KeyProfile | None = None,
                       time_col: str | None = None) -> DataFrame:
    """Add every feature's columns to ``df`` (rows and input columns unchanged)."""
    if not features:
        return df
    base_cols = list(df.columns)
    names = [n for f in features for n in f.names]
    clash = set(names) & set(base_cols)
    if clash:
        raise ValueError(f"feature columns already present: {sorted(clash)}")
    if len(set(names)) != len(names):
        raise ValueError("duplicate feature names requested")
    if profile is None:
        keys = sorted({k for f in features for k in f.combo})
        profile = profile_keys(df, keys, time_col) if time_col else profile_keys(df, keys)

    # each feature may broadcast one table: their sum is bounded too
    profile = replace(profile, broadcast_rows=min(profile.broadcast_rows, BROADCAST_TOTAL_ROWS // len(features)))
    rooted: dict[tuple[str, ...], list[KeyedFeature]] = {}
    second: list[KeyedFeature] = []
    small_stats = [f for f in features if f.group_stat and profile.can_broadcast(f.combo)]
    spread = [f for f in features if not (f.group_stat and profile.can_broadcast(f.combo))]
    profile = profile_key_sets(df, profile, [f.combo for f in spread])
    roots = profile.roots([f.combo for f in spread])
    n_slices = root_partitions(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), profile)
    sliced = sliceable(spread, roots, profile, n_slices) if ROW_ID in base_cols else []
    if sliced:
        df = reliable_checkpoint(df)
        bucket, slices, largest = time_slices(df, sliced[0].sliced.time_col, profile, n_slices)
        if largest > profile.hot_rows:  # a burst that no slice divides
            sliced = []
    if sliced:  # their edges take half of what may be broadcast
        profile = replace(profile, broadcast_rows=min(profile.broadcast_rows, BROADCAST_TOTAL_ROWS // 2 // len(features)))
        small_stats = [f for f in small_stats if profile.can_broadcast(f.combo)]
        spread = [f for f in features if f not in small_stats and f not in sliced]
        roots = profile.roots([f.combo for f in spread])
    for f in spread:
        root = roots[f.combo]
        if root is None:
            second.append(f)
        else:
            rooted.setdefault(root, []).append(f)

    # two or more roots: each root's windows run on a narrow branch of the input
    # and the branches meet on the unique row id (one exchange per side), so a
    # root's sorts carry only its own features instead of every earlier one
    branch = ROW_ID in base_cols and len(rooted) + bool(sliced) >= 2
    # the output chain itself, every reduced/broadcast aggregate, every branch
    readers = 1 + len(small_stats) + len(second) + (len(rooted) if branch else 0)
    if readers > 1 and not sliced:
        # the input feeds several plans: write it once to the reliable checkpoint
        # folder instead of recomputing its source for each reader
        df = reliable_checkpoint(df)
    if branch and len(rooted) == 1:
        branch = has_row_ids(df)  # else the one root goes on from the slices, with their columns
    elif branch:
        check_row_ids(df)
    out = _window_slices(df, sliced, bucket, slices, n_slices) if sliced else df
    stats_base = tuple_table(df, small_stats, profile) if len(small_stats) > 1 else None
    for f in small_stats:
        out = f.apply_second(out, stats_base if stats_base is not None else df, profile)
    for f in second:
        out = f.apply_second(out, df, profile)
    # roots with the fewest outputs first: later shuffles carry the fewest columns
    for root in sorted(rooted, key=lambda r: sum(len(f.names) for f in rooted[r])):
        if branch:
            part = _window_root(df, root, rooted[root], profile)
            out = out.join(part.select(ROW_ID, *[n for f in rooted[root] for n in f.names]), ROW_ID)
        else:
            out = _window_root(out, root, rooted[root], profile)
    return out.select(*base_cols, *names)
