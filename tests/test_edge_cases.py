"""Hand-made cases of FIXTURES.md part C, under both physical plans."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickfeat.functions.datetime import date_time_features
from clickfeat.operators.gaps import click_gaps
from clickfeat.operators.groups import group_click_count, unique_counts
from clickfeat.operators.prep import after_cutoff
from clickfeat.operators.ranges import check_range, count_in_range
from clickfeat.operators.skew import forced_profile
from clickfeat.operators.testmap import map_test_ids

PLANS = [forced_profile("window"), forced_profile("second"),
         forced_profile("second", broadcast=True)]
IDS = ["window", "second-shuffle", "second-broadcast"]
SCHEMA = "row_id long, ip long, app int, click_time_int_seconds int"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _get(df, col):
    return [r[col] for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("profile", PLANS, ids=IDS)
def test_lone_row(spark, profile):
    df = _rows(spark, [(1, 7, 1, 100)])
    g = click_gaps(df, [("ip",)], profile=profile)
    assert _get(g, "ip_dt_forward") == [None] and _get(g, "ip_dt_backward") == [None]
    c = count_in_range(df, [("ip",)], 0, 3600, profile=profile)
    assert _get(c, "count_groupby_ip_in_time_range_0_3600_seconds") == [1]
    assert _get(group_click_count(df, [("ip",)], profile=profile), "count_groupby_ip") == [1]


@pytest.mark.parametrize("profile", PLANS, ids=IDS)
def test_tie(spark, profile):
    df = _rows(spark, [(1, 7, 1, 100), (2, 7, 1, 100), (3, 7, 1, 100)])
    g = click_gaps(df, [("ip",)], profile=profile)
    assert _get(g, "ip_dt_forward") == [0.0, 0.0, None]
    assert _get(g, "ip_dt_backward") == [None, 0.0, 0.0]
    c = count_in_range(df, [("ip",)], 0, 3600, profile=profile)
    assert _get(c, "count_groupby_ip_in_time_range_0_3600_seconds") == [3, 3, 3]
    b = count_in_range(df, [("ip",)], -3600, 0, profile=profile)
    assert _get(b, "count_groupby_ip_in_time_range_-3600_0_seconds") == [3, 3, 3]


@pytest.mark.parametrize("profile", PLANS, ids=IDS)
def test_day_wrap(spark, profile):
    df = _rows(spark, [(1, 7, 1, 0), (2, 7, 1, 86405)])
    assert _get(click_gaps(df, [("ip",)], "forward", profile=profile), "ip_dt_forward") == [5.0, None]
    raw = click_gaps(df, [("ip",)], "forward", wrap_days=False, profile=profile)
    assert _get(raw, "ip_dt_forward") == [86405.0, None]
    one_day = _rows(spark, [(1, 7, 1, 0), (2, 7, 1, 86400)])
    assert _get(click_gaps(one_day, [("ip",)], "forward", profile=profile), "ip_dt_forward") == [0.0, None]


@pytest.mark.parametrize("profile", PLANS, ids=IDS)
def test_closed_frames(spark, profile):
    df = _rows(spark, [(1, 7, 1, 0), (2, 7, 1, 3600)])
    fwd = count_in_range(df, [("ip",)], 0, 3600, profile=profile)
    assert _get(fwd, "count_groupby_ip_in_time_range_0_3600_seconds") == [2, 1]
    back = count_in_range(df, [("ip",)], -3600, 0, profile=profile)
    assert _get(back, "count_groupby_ip_in_time_range_-3600_0_seconds") == [1, 2]


@pytest.mark.parametrize("profile", PLANS, ids=IDS)
def test_groups_are_separate(spark, profile):
    df = _rows(spark, [(1, 7, 1, 0), (2, 8, 1, 10), (3, 7, 2, 20), (4, 7, 1, 30)])
    g = click_gaps(df, [("ip",), ("ip", "app")], profile=profile)
    assert _get(g, "ip_dt_forward") == [20.0, None, 10.0, None]
    assert _get(g, "ip_app_dt_forward") == [30.0, None, None, None]
    u = unique_counts(df, [("ip",)], ["ip", "app"], profile=profile)
    assert _get(u, "unique_count_app_groupby_ip") == [2, 1, 2, 2]


def test_all_five_keys_gives_no_unique_columns(spark):
    cols = ["ip", "app", "device", "os", "channel"]
    df = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 0)], "row_id long, ip long, app int, device int, os int, "
                                                       "channel int, click_time_int_seconds int")
    out = unique_counts(df, [tuple(cols)], cols, profile=forced_profile("window"))
    assert out.columns == df.columns


def test_no_range_is_group_count(spark):
    df = _rows(spark, [(1, 7, 1, 0), (2, 7, 1, 90000), (3, 8, 1, 5)])
    out = count_in_range(df, [("ip",)], profile=forced_profile("window"))
    assert _get(out, "count_groupby_ip") == [2, 2, 1]
    with pytest.raises(ValueError):
        count_in_range(df, [("ip",)], 0, None)


def test_bad_range():
    for back, fwd in [(1, 3600), (0, -1)]:
        with pytest.raises(ValueError):
            check_range(back, fwd)
    with pytest.raises(TypeError):
        check_range(0.5, 10)


def test_bad_direction(spark):
    df = _rows(spark, [(1, 7, 1, 0)])
    with pytest.raises(ValueError):
        click_gaps(df, [("ip",)], "sideways", profile=forced_profile("window"))


def test_date_parts(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 11, 6, 12, 0, 0),), (dt.datetime(2017, 11, 12, 18, 30, 0),)],
                               "click_time timestamp")
    r = date_time_features(df).orderBy("click_time").collect()
    assert r[0]["weekday"] == 0 and r[1]["weekday"] == 6  # Monday = 0, Sunday = 6
    assert r[0]["hour_of_day"] == 12.0
    assert abs(r[0]["hour_of_day_sin"]) < 1e-6 and abs(r[0]["hour_of_day_cos"] - 1.0) < 1e-6
    assert abs(r[1]["hour_of_day"] - 18.5) < 1e-6
    assert (r[0]["year"], r[0]["month"], r[0]["day"]) == (2017, 11, 6)


def test_boundary_tie_kept(spark):
    t = dt.datetime(2017, 11, 9, 16, 0, 0)
    train = spark.createDataFrame([(t - dt.timedelta(seconds=5),), (t,)], "click_time timestamp")
    supp = spark.createDataFrame([(1, t - dt.timedelta(seconds=1)), (2, t), (3, t + dt.timedelta(seconds=1))],
                                 "click_id long, click_time timestamp")
    kept = sorted(r.click_id for r in after_cutoff(supp, train).collect())
    assert kept == [2, 3]


def test_test_id_map_duplicates_and_misses(spark):
    cols = "ip long, app int, device int, os int, channel int, click_time timestamp"
    t0 = dt.datetime(2017, 11, 10, 4, 0, 0)
    supp = spark.createDataFrame([(11, 1, 1, 1, 1, 1, t0), (12, 1, 1, 1, 1, 1, t0), (13, 2, 1, 1, 1, 1, t0)],
                                 "click_id long, " + cols)
    test = spark.createDataFrame([(100, 1, 1, 1, 1, 1, t0), (101, 1, 1, 1, 1, 1, t0), (102, 9, 1, 1, 1, 1, t0)],
                                 "click_id long, " + cols)
    got = {r.new_click_id: r.old_click_id for r in map_test_ids(test, supp).collect()}
    assert got == {100: 11, 101: 11, 102: None}


@pytest.mark.parametrize("profile", PLANS, ids=IDS)
def test_null_key_gets_null_features(spark, profile):
    df = _rows(spark, [(1, 7, 1, 0), (2, None, 1, 10), (3, 7, 1, 20), (4, None, 1, 30)])
    g = click_gaps(df, [("ip",)], profile=profile)
    assert _get(g, "ip_dt_forward") == [20.0, None, None, None]
    c = count_in_range(df, [("ip",)], 0, 3600, profile=profile)
    assert _get(c, "count_groupby_ip_in_time_range_0_3600_seconds") == [2, None, 1, None]
    n = group_click_count(df, [("ip",)], profile=profile)
    assert _get(n, "count_groupby_ip") == [2, None, 2, None]
    u = unique_counts(df, [("ip",)], ["ip", "app"], profile=profile)
    assert _get(u, "unique_count_app_groupby_ip") == [1, None, 1, None]
