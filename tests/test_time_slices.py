"""Gaps of combinations with few, large groups: one exchange by time instead of a join of all rows per combination."""

import random

import pytest
from pyspark.sql import functions as F

from clickfeat.operators import keyed
from clickfeat.operators.combos import feature_combinations
from clickfeat.operators.gaps import click_gaps
from clickfeat.operators.skew import forced_profile, profile_key_sets, profile_keys

KEYS = ("app", "device", "os", "channel")
ALL = feature_combinations(KEYS)


@pytest.fixture(scope="module")
def clicks(spark):
    r = random.Random(5)
    some = lambda n: r.choice([None, *range(n)])
    rows = [(i, some(3), some(2), some(4), some(5), r.choice([None, 7, 500_000, r.randrange(400), r.randrange(200_000)])) for i in range(900)]
    return spark.createDataFrame(rows, "row_id long, app int, device int, os int, channel int, click_time_int_seconds int")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("direction,wrap", [("both", True), ("forward", False), ("backward", True)])
def test_slices_agree_with_windows(clicks, direction, wrap):
    profile = profile_keys(clicks, KEYS, hot_rows=400, min_root_distinct=1000)
    want = rows(click_gaps(clicks, ALL, direction, wrap_days=wrap, profile=forced_profile("window")))
    assert rows(click_gaps(clicks, ALL, direction, wrap_days=wrap, profile=profile)) == want


def test_all_small_combinations_share_one_exchange_by_time(clicks):
    profile = profile_keys(clicks, KEYS, hot_rows=400, min_root_distinct=1000)
    plan = click_gaps(clicks, ALL, "both", profile=profile)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Join LeftOuter") == plan.count("rightHint=(strategy=broadcast)") - 1 == len(ALL)


def test_bursts_and_many_groups_are_not_sliced(spark, clicks):
    burst = clicks.withColumn("click_time_int_seconds", F.when(F.col("row_id") < 600, 9).otherwise(F.col("row_id").cast("int")))
    profile = profile_keys(burst, KEYS, hot_rows=400, min_root_distinct=1000)
    _, _, largest = keyed.time_slices(burst, "click_time_int_seconds", profile, 8)
    assert largest >= 600
    assert rows(click_gaps(burst, ALL, "both", profile=profile)) == rows(click_gaps(burst, ALL, "both", profile=forced_profile("window")))
    counted = profile_key_sets(clicks, profile, ALL)
    from clickfeat.operators.gaps import gap_features
    feats = gap_features(ALL)
    assert len(keyed.sliceable(feats, {f.combo: None for f in feats}, counted, 8)) == len(ALL)
    assert len(keyed.sliceable(feats, {f.combo: None for f in feats}, counted, 10**6)) < len(ALL)


def test_one_root_beside_slices_takes_repeated_row_ids(spark, clicks):
    """Only branches of several roots need row ids of their own; slices beside one root do not."""
    from pyspark.sql import Window
    df = clicks.withColumn("ip", (F.col("row_id") % 300).cast("int"))
    combos = [("ip",), ("app",), ("device", "os")]
    for part in (df, df.union(df)):
        profile = profile_keys(part, ("ip", *KEYS), hot_rows=part.count() // 2, min_root_distinct=250)
        assert profile.roots(combos) == {("ip",): ("ip",), ("app",): None, ("device", "os"): None}
        got = click_gaps(part, combos, "forward", wrap_days=False, profile=profile)
        t, want = F.col("click_time_int_seconds"), part
        for c in combos:
            gap = F.lead(t).over(Window.partitionBy(*c).orderBy(t, "row_id")) - t
            want = want.withColumn("_".join(c) + "_gap", F.when(F.concat(*c).isNotNull(), gap).cast("float"))
        # of rows with equal ids and times either may be the earlier one, so each feature is compared by itself
        assert got.count() == part.count()
        for c in combos:
            name = next(n for n in got.columns if n.startswith("_".join(c) + "_") and n not in part.columns)
            values = [sorted((str(r[0]) for r in df_.select(n).collect())) for df_, n in ((got, name), (want, "_".join(c) + "_gap"))]
            assert values[0] == values[1]
