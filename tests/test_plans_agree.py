"""The three physical plans give the same features on the fixture data, and the
result does not depend on the number of partitions."""
import pytest

from clickfeat.operators.combos import feature_combinations
from clickfeat.operators.skew import forced_profile, profile_keys
from clickfeat.plans.features import feature_table
from clickfeat.plans.queries import Inputs

from conftest import SF_SMALL

FAMS = ("time_delta", "unique_count", "count_groupby_0_3600", "count_groupby_0_21600")


def _collect(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def union(spark):
    return Inputs(spark, SF_SMALL).union.cache()


@pytest.fixture(scope="module")
def reference(union):
    return _collect(feature_table(union, FAMS, profile=forced_profile("window"), keep=("row_id",)))


@pytest.mark.parametrize("plan", ["second", "second-broadcast", "auto", "auto-hot"])
def test_plans_agree(union, reference, plan):
    if plan == "second":
        prof = forced_profile("second")
    elif plan == "second-broadcast":
        prof = forced_profile("second", broadcast=True)
    elif plan == "auto":
        prof = profile_keys(union)
    else:  # every root value counts as hot: all combinations take the reduced plan
        prof = profile_keys(union, hot_rows=1, broadcast_rows=50)
    got = _collect(feature_table(union, FAMS, profile=prof, keep=("row_id",)))
    assert got == reference


def test_layout_invariance(spark, union, reference):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _collect(feature_table(union.coalesce(1), FAMS, profile=profile_keys(union), keep=("row_id",)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == reference


def test_tuple_table_path(spark, union):
    """Many clicks per id tuple: group statistics come from the tuple table and
    still equal the window plan."""
    from pyspark.sql import functions as F
    import clickfeat.operators.keyed as keyed
    # few tuples: ip folded to 5 values, every row repeated 40 times
    rep = union.withColumn("ip", F.col("ip") % 5).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn(
        "row_id", F.col("row_id") * 40 + F.col("copy")).drop("copy")
    fams = ("unique_count",)
    want = _collect(feature_table(rep, fams, profile=forced_profile("window"), keep=("row_id",)))
    prof = profile_keys(rep, broadcast_rows=10 ** 9)
    calls = []
    orig = keyed.tuple_table
    keyed.tuple_table = lambda *a: calls.append(orig(*a)) or calls[-1]
    try:
        got = _collect(feature_table(rep, fams, profile=prof, keep=("row_id",)))
    finally:
        keyed.tuple_table = orig
    assert calls and calls[0] is not None  # the tuple table was used
    assert got == want
