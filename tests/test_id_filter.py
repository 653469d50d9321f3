"""Wide tables cut to the asked ids before their shuffle: nothing asked is lost, little else stays, and where the filter stands."""

import random

import pytest
from pyspark.sql import functions as F

from clickfeat.operators import folds as fo
from clickfeat.operators import idfilter
from clickfeat.plans.features import FAMILIES, read_features, build_features, manifest_names
from clickfeat.plans.queries import Inputs

from conftest import SF_SMALL


@pytest.mark.parametrize("size,asked", [(50_000, 10), (50_000, 2500), (200_000, 20_000), (1000, 0)])
def test_all_asked_rows_and_few_others(spark, size, asked):
    r = random.Random(asked)
    want = {r.randrange(size) * 10**7 + 3 for _ in range(asked)}
    table = spark.range(size).select((F.col("id") * 10**7 + 3).alias("row_id"), F.lit("wide").alias("__at2"))
    ids = spark.createDataFrame([(i,) for i in [*want, *want]] + [(None,), (-5,)], "other long")
    got = [x["row_id"] for x in idfilter.rows_asked_for(table, "row_id", ids, "other").collect()]
    assert want <= set(got) and len(set(got)) == len(got)
    assert len(got) - len(want) <= 0.1 * size


def test_the_bitmap_is_bounded():
    assert idfilter.bitmap_bits(0) == idfilter.CHUNK_BITS and idfilter.bitmap_bits(10**6) == 1 << 24
    assert idfilter.bitmap_bits(10**7) == idfilter.MAX_BITS and idfilter.bitmap_bits(10**9) == 0


def test_too_many_ids_leave_the_table_as_it_is(spark, monkeypatch):
    monkeypatch.setattr(idfilter, "MAX_BITS", 16)
    monkeypatch.setattr(idfilter, "CHUNK_BITS", 16)
    table = spark.range(100).toDF("row_id")
    assert idfilter.rows_asked_for(table, "row_id", table) is table


def test_every_family_is_cut_below_its_exchange(spark, tmp_path):
    inp = Inputs(spark, SF_SMALL)
    path, names = str(tmp_path / "features"), manifest_names()
    build_features(inp.union, path)
    folds = fo.balanced_folds(inp.train, 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        feats = read_features(spark, path, names, ids=folds)
        plan = feats._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # walking down the plan: between every shuffle on row_id and the scan below it stands the join with the bitmap
    shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(row_id" in line]
    assert len(shuffles) == len(FAMILIES)
    for i in shuffles:
        below = plan[i + 1:next(k for k in range(i, len(plan)) if "FileScan" in plan[k] or "Scan parquet" in plan[k])]
        assert any("BroadcastHashJoin" in line for line in below) and any("getbit" in line for line in below), below
    whole = fo.fold_features(folds, read_features(spark, path, names))
    cut = fo.fold_features(folds, feats)
    assert cut.exceptAll(whole).isEmpty() and cut.count() == whole.count() == folds.count()
