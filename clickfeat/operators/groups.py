"""Group statistics attached to each row: click counts and distinct counts (A1-A3),
their cube (A5), class counts (A6) and time bounds (A8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import ID_COLUMNS, LABEL, SECONDS, TIME, canonical, count_name, unique_count_name
from .combos import normalise_combos
from .keyed import KeyedFeature, WindowPlan, add_keyed_features, flag_name, null_key_guard
from .skew import KeyProfile, maybe_broadcast


def group_count_features(combos, *, dtype: str = "long") -> list[KeyedFeature]:
    return [_count_feature(c, dtype) for c in normalise_combos(combos)]


def _count_feature(combo, dtype) -> KeyedFeature:
    name = count_name(combo)

    def window_plan():
        w = Window.partitionBy(*combo)
        return WindowPlan(plain=[(name, null_key_guard(combo, F.count(F.lit(1)).over(w)).cast(dtype))])

    def apply_second(df: DataFrame, base: DataFrame, profile: KeyProfile) -> DataFrame:
        tmp = "__c_" + "_".join(combo)
        # ``base`` is the rows, or the tuple table whose ``__n`` counts them
        n = F.sum("__n") if "__n" in base.columns else F.count(F.lit(1))
        stats = base.groupBy(*combo).agg(n.alias(tmp))
        joined = df.join(maybe_broadcast(stats, profile, combo, False), on=list(combo), how="left")
        return joined.select(*df.columns, F.col(tmp).cast(dtype).alias(name))

    return KeyedFeature(combo, (name,), window_plan, apply_second, stat=("count",))


def group_click_count(df: DataFrame, combos, *, profile: KeyProfile | None = None, dtype: str = "long") -> DataFrame:
    """Add ``count_groupby_<keys>``: rows of the row's group (A1; also the meaning of
    the range count with no range, A2)."""
    return add_keyed_features(df, group_count_features(combos, dtype=dtype), profile)


def objectives_for(combo: Sequence[str], objective: Sequence[str]) -> tuple[str, ...]:
    """Objective columns not in the combination, by name (the published column order)."""
    return tuple(sorted(set(objective) - set(combo)))


def unique_count_features(combos, objective: Sequence[str] = ID_COLUMNS, *,
                          dtype: str = "long") -> list[KeyedFeature]:
    out = []
    for combo in normalise_combos(combos):
        objs = objectives_for(combo, objective)
        if objs:  # a combination holding every objective column yields nothing
            out.append(_unique_feature(combo, objs, dtype))
    return out


def _unique_feature(combo, objs, dtype) -> KeyedFeature:
    names = tuple(unique_count_name(x, combo) for x in objs)
    tag = "__u_" + "_".join(combo)

    def window_plan():
        # distinct values of x in group K = number of (K, x) groups starting in it:
        # the sum over K of the "first row of (K, x)" flag, on rows where x is not null.
        # The flag of (K, x) shares the sort of that key set's own features.
        whole = Window.partitionBy(*combo)
        plain, flags = [], []
        for x, n in zip(objs, names):
            ks = canonical((*combo, x))
            flags.append(ks)
            firsts = F.when(F.col(x).isNotNull(), F.col(flag_name(ks))).otherwise(F.lit(0))
            plain.append((n, null_key_guard(combo, F.sum(firsts).over(whole)).cast(dtype)))
        return WindowPlan(plain=plain, flags=flags)

    def apply_second(df: DataFrame, base: DataFrame, profile: KeyProfile) -> DataFrame:
        aggs = [F.count_distinct(x).alias(f"{tag}_{x}") for x in objs]
        stats = base.groupBy(*combo).agg(*aggs)
        joined = df.join(maybe_broadcast(stats, profile, combo, False), on=list(combo), how="left")
        return joined.select(*df.columns, *[F.col(f"{tag}_{x}").cast(dtype).alias(n) for x, n in zip(objs, names)])

    return KeyedFeature(combo, names, window_plan, apply_second, stat=("unique", objs))


def unique_counts(df: DataFrame, combos, objective: Sequence[str] = ID_COLUMNS, *,
                  profile: KeyProfile | None = None, dtype: str = "long") -> DataFrame:
    """Add ``unique_count_<x>_groupby_<keys>``: for every combination, the number of
    distinct values of each objective column not in it (nulls not counted)."""
    return add_keyed_features(df, unique_count_features(combos, objective, dtype=dtype), profile)


def cube_counts(df: DataFrame, cols: Sequence[str] = ID_COLUMNS, combos=None) -> DataFrame:
    """Click count of every group of every combination in one aggregate
    (``GROUPING SETS``, no grand total). ``combo`` names the combination; the id
    columns outside it are null."""
    cols = list(cols)
    combos = normalise_combos(combos) if combos is not None else None
    if combos is None:
        from .combos import feature_combinations
        combos = feature_combinations(cols)
    sets = [[F.col(c) for c in combo] for combo in combos]
    combo_name = F.concat_ws("_", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in cols])
    # rows collapse to their tuples before they are copied once per combination
    tuples = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return tuples.groupingSets(sets, *cols).agg(F.sum("__n").alias("n_clicks"), combo_name.alias("combo"))


def class_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per label value."""
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


def time_bounds(df: DataFrame, time_col: str = TIME, seconds_col: str = SECONDS) -> DataFrame:
    """First and last click (A8): one row."""
    return df.agg(F.min(time_col).alias("first_click"), F.max(time_col).alias("last_click"),
                  F.min(seconds_col).alias("first_second"), F.max(seconds_col).alias("last_second"),
                  F.count(F.lit(1)).cast("long").alias("n_rows"))
