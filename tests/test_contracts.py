"""Contracts that hold under every plan: null times, row ids, headers, thresholds, alignment, large counts."""

import pytest
from pyspark.sql import functions as F

from clickfeat.operators import folds as fo
from clickfeat.operators.keyed import check_row_ids
from clickfeat.operators.metrics import auc
from clickfeat.operators.ranges import count_in_range
from clickfeat.operators.skew import profile_keys
from clickfeat.sources.clicks import read_clicks_train


def test_null_times_count_alike_under_both_plans(spark):
    df = spark.createDataFrame([(1, 7, None), (2, 7, None), (3, 7, 10), (4, 7, 20), (5, None, 20)], "row_id long, ip int, click_time_int_seconds int")
    out = []
    for hot in (10**6, 0):
        got = count_in_range(df, [("ip",)], 0, 15, profile=profile_keys(df, ["ip"], hot_rows=hot))
        out.append([r[-1] for r in got.orderBy("row_id").collect()])
    assert out[0] == out[1] == [2, 2, 2, 1, None]


def test_row_ids_must_be_unique(spark):
    check_row_ids(spark.range(5).withColumnRenamed("id", "row_id"))
    for ids in ([1, 1], [1, None]):
        with pytest.raises(ValueError):
            check_row_ids(spark.createDataFrame([(i,) for i in ids], "row_id long"))


def test_csv_columns_follow_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("app,ip,device,os,channel,click_time,attributed_time,is_attributed\n3,87540,1,13,497,2017-11-07 09:30:38,,0\n")
    r = read_clicks_train(spark, str(tmp_path / "a.csv")).first()
    assert (r["ip"], r["app"]) == (87540, 3)
    (tmp_path / "b.csv").write_text("app,device,os,channel,click_time,attributed_time,is_attributed\n3,1,13,497,2017-11-07 09:30:38,,0\n")
    with pytest.raises(ValueError):
        read_clicks_train(spark, str(tmp_path / "b.csv"))


def test_small_fractions_have_a_threshold():
    assert int(fo.fraction_threshold(2.0 ** -60), 16) == 16 ** 32 // 2 ** 60
    assert fo.fraction_threshold(0.0) == "0" * 32


def test_too_few_negatives_raise(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "row_id long, is_attributed int")
    with pytest.raises(ValueError):
        fo.balanced_folds(df, 1)


def test_alignment_sees_lost_and_doubled_rows(spark):
    a = spark.createDataFrame([(0, 1), (1, 1), (0, 2)], "fold int, row_id long")
    b = spark.createDataFrame([(0, 1), (0, 2), (0, 2)], "fold int, row_id long")
    assert tuple(fo.check_alignment(a, b, ["fold", "row_id"]).first()) == (1, 1)
    assert tuple(fo.check_alignment(a, a, ["fold", "row_id"]).first()) == (0, 0)


def test_auc_of_many_rows_does_not_overflow(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1)], "score double, is_attributed int")
    big = 5_000_000_000
    num = spark.range(1).select((F.lit(big).cast("double") * F.lit(big * 400)).alias("x")).first()["x"]
    assert num > 0 and auc(df, "score").first()["auc"] == 1.0
