"""The fold rows that models are fitted on: stored so that a fold's fit reads that fold alone."""

from clickfeat.plans.queries import _stored_folds


def test_a_fold_reads_its_own_files_and_columns(spark):
    rows = spark.range(300).selectExpr("cast(id % 3 as int) fold", "id row_id", "id % 2 = 0 is_valid", "cast(id as float) a", "cast(null as float) b")
    back = _stored_folds(spark, rows)
    assert back.dtypes == rows.dtypes
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    plan = back.filter("fold = 1").select("row_id", "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and "ReadSchema: struct<row_id:bigint,a:float>" in plan
