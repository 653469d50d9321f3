"""Range counts as differences of growing sums: brute force, dense groups, null times, the plan's frames."""

import random
import time

import pytest
from pyspark.sql import functions as F

from clickfeat.operators.ranges import count_in_range, count_in_range_for
from clickfeat.operators.skew import forced_profile

RANGES = [(0, 3600), (-3600, 0), (-50, 100), (0, 0), (-7, 0)]


def by_force(rows, back, fwd):
    """(row id -> count) of rows (id, key, time)."""
    out = {}
    for i, k, t in rows:
        if k is None:
            out[i] = None
        else:
            out[i] = sum(1 for _, k2, t2 in rows if k2 == k and (t2 is None if t is None else t2 is not None and t + back <= t2 <= t + fwd))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(i, r.choice([1, 1, 2, None]), r.choice([None, *range(0, 9000, 37), 500, 501, 502])) for i in range(400)]


@pytest.mark.parametrize("back,fwd", RANGES)
@pytest.mark.parametrize("plan", ["window", "second"])
def test_counts_match_brute_force(spark, rows, back, fwd, plan):
    df = spark.createDataFrame(rows, "row_id long, ip long, click_time_int_seconds int")
    out = count_in_range(df, [("ip",)], back, fwd, profile=forced_profile(plan))
    assert {r[0]: r[3] for r in out.collect()} == by_force(rows, back, fwd)


@pytest.mark.parametrize("back,fwd", RANGES)
def test_probes_match_brute_force(spark, rows, back, fwd):
    """Probes with and without time, with null and unknown keys, repeated, and with columns named as the events'."""
    probes = [(1000 + i, k, t) for i, (_, k, t) in enumerate(rows[:150])] + [(2000, 77, 5), (2001, 1, 10**6), (2002, 1, None), (2002, 1, None)]
    got = count_in_range_for(spark.createDataFrame(probes, "row_id long, ip long, click_time_int_seconds int"),
                             spark.createDataFrame(rows, "row_id long, ip long, click_time_int_seconds int"), ["ip"], back, fwd, name="n")
    assert got.columns == ["row_id", "ip", "click_time_int_seconds", "n"]
    want = []
    for i, k, t in probes:
        n = None if k is None else sum(1 for _, k2, t2 in rows if k2 == k and (t2 is None if t is None else t2 is not None and t + back <= t2 <= t + fwd))
        want.append((i, k, t, n))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_dense_group_costs_its_rows_once(spark):
    """100,000 clicks of one group, all within one six-hour range (a moving frame took over half a minute)."""
    df = spark.range(100_000).select(F.col("id").alias("row_id"), F.lit(1).alias("ip"), (F.col("id") % 21_000).cast("int").alias("click_time_int_seconds"))
    count_in_range(df.limit(10), [("ip",)], 0, 21_600, profile=forced_profile("window")).count()
    began = time.time()
    out = count_in_range(df, [("ip",)], 0, 21_600, profile=forced_profile("window"))
    last = out.columns[-1]
    got = out.agg(F.max(last), F.min(last), F.sum(last)).first()
    took = time.time() - began
    sizes = [100_000 // 21_000 + (s < 100_000 % 21_000) for s in range(21_000)]
    later, total = 0, 0
    for n in reversed(sizes):
        later += n
        total += n * later
    assert (got[0], got[2]) == (100_000, total) and took < 5, took


def test_frames_only_grow(spark):
    df = spark.createDataFrame([(1, 1, 1)], "row_id long, ip long, click_time_int_seconds int")
    for (back, fwd), second in (((0, 3600), "rank("), ((-60, 3600), "RangeFrame, unboundedpreceding$(), -61")):
        plan = count_in_range(df, [("ip",)], back, fwd, profile=forced_profile("window"))._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame, unboundedpreceding$(), 3600" in plan and second in plan
        assert "RangeFrame, currentrow$()" not in plan
