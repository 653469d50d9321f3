"""Clicks of the same group inside a time range around each click."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import SECONDS, as_keys, range_count_name
from .combos import normalise_combos
from .keyed import KeyedFeature, WindowPlan, add_keyed_features, null_key_guard
from .skew import KeyProfile, maybe_broadcast


def check_range(back, fwd) -> tuple[int, int]:
    """``back <= 0 <= fwd``, whole seconds; the range is closed at both ends."""
    for v in (back, fwd):
        if isinstance(v, bool) or not isinstance(v, int):
            raise TypeError("range bounds must be whole seconds (int)")
    if back > 0:
        raise ValueError("the backward bound must be zero or negative")
    if fwd < 0:
        raise ValueError("the forward bound must be zero or positive")
    return back, fwd


def in_range(keys, time_col: str, back: int, fwd: int, value: Column | None = None) -> Column:
    """Rows of the group (or the sum of their ``value``) with time in ``[t + back, t + fwd]``.

    The difference of two sums that only grow along the group (up to ``t + fwd``, and up to just before ``t + back``),
    so a group costs its rows once, however many of them a range holds; a frame with two moving ends would be added up
    anew whenever it moves. Rows without time come first and are each other's peers: both sums of a row with a time hold
    them, and a row without has them all in its first.
    """
    w = Window.partitionBy(*keys).orderBy(time_col)
    added = F.count(F.lit(1)) if value is None else F.sum(value)
    upto = added.over(w.rangeBetween(Window.unboundedPreceding, fwd))
    if value is None and back == 0:
        return upto - F.rank().over(w) + 1  # a row's rank less one: the rows before its second (none for rows without time)
    before = added.over(w.rangeBetween(Window.unboundedPreceding, back - 1))
    return F.when(F.col(time_col).isNull(), upto).otherwise(upto - F.coalesce(before, F.lit(0)))


def range_count_features(combos, back: int, fwd: int, *, time_col: str = SECONDS,
                         dtype: str = "long") -> list[KeyedFeature]:
    back, fwd = check_range(back, fwd)
    return [_range_feature(c, back, fwd, time_col, dtype) for c in normalise_combos(combos)]


def _range_feature(combo, back, fwd, time_col, dtype) -> KeyedFeature:
    name = range_count_name(combo, back, fwd)

    def window_plan():
        return WindowPlan(ranged=[(name, null_key_guard(combo, in_range(combo, time_col, back, fwd)).cast(dtype))])

    def apply_second(df: DataFrame, base: DataFrame, profile: KeyProfile) -> DataFrame:
        # clicks per (keys, second) first; the same sums over that table are
        # exact because all clicks of one second share their result
        tag = "__r_" + "_".join(combo) + f"_{-back}_{fwd}"
        n, total = tag + "_n", tag + "_total"
        per_second = (base.groupBy(*combo, time_col).agg(F.count(F.lit(1)).alias(n))
                      .select(*combo, time_col, in_range(combo, time_col, back, fwd, F.col(n)).alias(total)))
        # null times are peers of each other, as in the window plan; null keys match nothing
        keys = {c: f"{tag}_{i}" for i, c in enumerate((*combo, time_col))}
        side = maybe_broadcast(per_second.withColumnsRenamed(keys), profile, combo, True)
        same = df[time_col].eqNullSafe(side[keys[time_col]])
        for c in combo:
            same = same & (df[c] == side[keys[c]])
        joined = df.join(side, same, "left")
        return joined.select(*df.columns, F.col(total).cast(dtype).alias(name))

    return KeyedFeature(combo, (name,), window_plan, apply_second)


def count_in_range(df: DataFrame, combos, back: int | None = None, fwd: int | None = None, *,
                   time_col: str = SECONDS, profile: KeyProfile | None = None, dtype: str = "long") -> DataFrame:
    """Add ``count_groupby_<keys>_in_time_range_<back>_<fwd>_seconds``: clicks of the
    row's group with time in ``[t + back, t + fwd]``, the row and its ties included.
    With no range at all, the count of the whole group, ``count_groupby_<keys>`` (A2)."""
    if back is None and fwd is None:
        from .groups import group_click_count
        return group_click_count(df, combos, profile=profile, dtype=dtype)
    if back is None or fwd is None:
        raise ValueError("give both range bounds, or neither for the whole-group count")
    feats = range_count_features(combos, back, fwd, time_col=time_col, dtype=dtype)
    return add_keyed_features(df, feats, profile, time_col)


def count_in_range_for(probes: DataFrame, events: DataFrame, keys, back: int = -3600, fwd: int = 3600, *,
                       time_col: str = SECONDS, name: str | None = None, dtype: str = "long") -> DataFrame:
    """For each probe row, the events of its group with time in ``[t + back, t + fwd]``.

    Probes and events are both reduced to one row per (keys, second) - events
    with their count, probes with 0 - added together, and summed along each group (see :func:`in_range`); the result is
    joined back to the probes. No pair of rows is ever formed, and a group's window holds at most its distinct seconds.
    A probe without time counts the events of its group that have none, as :func:`count_in_range` does; a null key gives null.
    """
    keys = as_keys(keys)
    back, fwd = check_range(back, fwd)
    name = name or range_count_name(keys, back, fwd)
    n = "__events"
    ev = events.select(*keys, time_col, F.lit(1).cast("long").alias(n), F.lit(False).alias("__probe"))
    pr = probes.select(*keys, time_col, F.lit(0).cast("long").alias(n), F.lit(True).alias("__probe"))
    per_second = ev.unionByName(pr).groupBy(*keys, time_col).agg(F.sum(n).alias(n), F.max("__probe").alias("__probe"))
    counted = per_second.select(*keys, time_col, "__probe", in_range(keys, time_col, back, fwd, F.col(n)).alias("__total")).filter("__probe")
    other = {c: f"__key_{i}" for i, c in enumerate((*keys, time_col))}
    side = counted.drop("__probe").withColumnsRenamed(other)
    same = probes[time_col].eqNullSafe(side[other[time_col]])
    for k in keys:
        same = same & (probes[k] == side[other[k]])
    return probes.join(side, same, "left").select(*[probes[c] for c in probes.columns], F.col("__total").cast(dtype).alias(name))
