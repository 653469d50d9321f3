"""Properties of the features on the fixture data, and brute-force checks."""
import pytest
from pyspark.sql import functions as F, Window

from clickfeat.operators import folds as fo
from clickfeat.operators.gaps import click_gaps
from clickfeat.operators.groups import group_click_count, unique_counts
from clickfeat.operators.metrics import auc
from clickfeat.operators.prep import take_split
from clickfeat.operators.ranges import count_in_range, count_in_range_for
from clickfeat.operators.skew import profile_keys
from clickfeat.plans.queries import Inputs

from conftest import SF_SMALL, SF_MID

S = "click_time_int_seconds"


@pytest.fixture(scope="module")
def inp(spark):
    return Inputs(spark, SF_SMALL)


@pytest.fixture(scope="module")
def union(inp):
    return inp.union.cache()


def test_forward_backward_mirror(union):
    g = click_gaps(union, [("ip", "app")], wrap_days=False)
    w = Window.partitionBy("ip", "app").orderBy(S, "row_id")
    nxt = g.select("ip_app_dt_forward", F.lead("ip_app_dt_backward").over(w).alias("succ_back"))
    bad = nxt.filter(~F.col("ip_app_dt_forward").eqNullSafe(F.col("succ_back"))).count()
    assert bad == 0


def test_range_counts_monotone(union):
    c = count_in_range(union, [("ip",)], 0, 0)
    c = count_in_range(c, [("ip",)], 0, 3600)
    c = count_in_range(c, [("ip",)], 0, 21600)
    a, b, d = ("count_groupby_ip_in_time_range_0_0_seconds", "count_groupby_ip_in_time_range_0_3600_seconds",
               "count_groupby_ip_in_time_range_0_21600_seconds")
    assert c.filter((F.col(a) < 1) | (F.col(b) < F.col(a)) | (F.col(d) < F.col(b))).count() == 0


def test_range_count_equals_self_join(union):
    got = count_in_range(union, [("ip", "app")], -3600, 600).select(
        "row_id", F.col("count_groupby_ip_app_in_time_range_-3600_600_seconds").alias("n"))
    a, b = union.alias("a"), union.alias("b")
    brute = (a.join(b, (F.col("a.ip") == F.col("b.ip")) & (F.col("a.app") == F.col("b.app"))
                    & (F.col(f"b.{S}") >= F.col(f"a.{S}") - 3600) & (F.col(f"b.{S}") <= F.col(f"a.{S}") + 600))
             .groupBy(F.col("a.row_id").alias("row_id")).agg(F.count(F.lit(1)).cast("int").alias("n")))
    assert sorted(got.collect()) == sorted(brute.collect())


def test_probe_counts_equal_self_join(inp, union):
    probes = inp.test.select("click_id", "ip", F.unix_timestamp("click_time").cast("int").alias(S))
    got = count_in_range_for(probes, union, ("ip",), -3600, 3600, name="n").select("click_id", "n")
    p, e = probes.alias("p"), union.alias("e")
    brute = (p.join(e, (F.col("p.ip") == F.col("e.ip")) & (F.col(f"e.{S}").between(F.col(f"p.{S}") - 3600,
                                                                                     F.col(f"p.{S}") + 3600)), "left")
             .groupBy(F.col("p.click_id").alias("click_id")).agg(F.count("e.row_id").cast("int").alias("n")))
    assert sorted(got.collect()) == sorted(brute.collect())


def test_unique_not_above_group_count(union):
    u = unique_counts(union, [("ip",), ("app", "os")])
    u = group_click_count(u, [("ip",), ("app", "os")])
    cond = (F.col("unique_count_app_groupby_ip") > F.col("count_groupby_ip")) | \
           (F.col("unique_count_ip_groupby_app_os") > F.col("count_groupby_app_os"))
    assert u.filter(cond).count() == 0


def test_balanced_folds(inp, union):
    train = take_split(union, "train")
    folds = fo.balanced_folds(train, 4)
    n_pos = train.filter("is_attributed = 1").count()
    per = {(r.fold, r.is_attributed): r.n for r in folds.groupBy("fold", "is_attributed").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    for f in range(4):
        assert per[(f, 1)] == n_pos and per[(f, 0)] == n_pos
    assert folds.groupBy("fold", "row_id").count().filter("count > 1").count() == 0


def test_exact_n_equals_row_number(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("g"))
    df = df.withColumn("h", fo.seeded_hash(7))
    n = spark.createDataFrame([(0, 10), (1, 1500), (2, 4000)], "g int, n long")
    got = fo.smallest_n_per_group(df, "g", "h", "row_id", n).select("g", "row_id")
    w = Window.partitionBy("g").orderBy("h", "row_id")
    brute = (df.join(n, "g").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.col("n"))
             .select("g", "row_id"))
    assert sorted(got.collect()) == sorted(brute.collect())


def test_auc_matches_spark_ml(spark, union):
    from clickfeat.operators.model import evaluator_auc
    train = take_split(union, "train").select(F.col("app").cast("double").alias("score"), "is_attributed")
    ours = auc(train, "score").first()["auc"]
    assert abs(ours - evaluator_auc(train)) < 1e-9


def test_profile(union):
    p = profile_keys(union)
    assert p.total_rows == union.count()
    assert p.distinct["device"] <= 3 and p.max_group["ip"] >= 1


def test_auc_with_ties_and_groups_brute_force(spark):
    rows = [("a", 0.1, 0), ("a", 0.4, 1), ("a", 0.4, 0), ("a", 0.8, 1), ("a", 0.35, 0),
            ("b", 1.0, 1), ("b", 1.0, 0), ("b", 2.0, 1), ("b", 0.5, 0), ("b", 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, score double, is_attributed int").repartition(3)
    got = {r.g: r.auc for r in auc(df, "score", group_cols=["g"]).collect()}
    for g in ("a", "b"):
        pos = [s for k, s, y in rows if k == g and y == 1]
        neg = [s for k, s, y in rows if k == g and y == 0]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got[g] - want) < 1e-12


def test_sample_fraction_layout_independent(union):
    a = sorted(r.row_id for r in fo.sample_fraction(union, 0.3, 7).select("row_id").collect())
    b = sorted(r.row_id for r in fo.sample_fraction(union.repartition(5), 0.3, 7).select("row_id").collect())
    n = union.count()
    assert a == b and 0.2 * n < len(a) < 0.4 * n
