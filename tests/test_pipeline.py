"""End to end from CSV files written from the fixture: every step runs and the
step outputs agree with the registered queries."""
import tempfile
import uuid

from pyspark.sql import functions as F

from clickfeat.operators.model import BoostParams
from clickfeat.plans import pipeline
from clickfeat.plans.queries import Inputs
from clickfeat.sources.clicks import write_clicks_csv

from conftest import SF_SMALL


def test_pipeline_end_to_end(spark):
    inp = Inputs(spark, SF_SMALL)
    tmp = tempfile.mkdtemp(prefix="clickfeat-pipe-")
    ids = ["ip", "app", "device", "os", "channel", "click_time"]
    # file order = time order, as in the original files
    write_clicks_csv(inp.train.orderBy("click_time", "row_id").coalesce(1)
                     .select(*ids, "attributed_time", "is_attributed"), f"{tmp}/csv/train")
    write_clicks_csv(inp.supplement.orderBy("click_time", "click_id").coalesce(1)
                     .select("click_id", *ids), f"{tmp}/csv/supplement")
    write_clicks_csv(inp.test.coalesce(1).select("click_id", *ids), f"{tmp}/csv/test")
    out = f"{tmp}/out"
    preds = pipeline.run_all(spark, f"{tmp}/csv/train", f"{tmp}/csv/supplement", f"{tmp}/csv/test", out,
                             n_folds=2, params=BoostParams(max_iter=3, max_depth=3))
    pipeline.dev_sample(spark, out, fraction=0.2)
    small = spark.read.parquet(f"{out}/train_small").count()
    assert 0 < small < inp.train.count()
    from clickfeat.operators.model import save_fold_dataset
    from clickfeat.operators.prep import drop_features
    from clickfeat.plans.features import manifest_names
    save_fold_dataset(spark.read.parquet(f"{out}/training_sets"), drop_features(manifest_names()), f"{out}/fold_data")
    assert spark.read.parquet(f"{out}/fold_data").count() == spark.read.parquet(f"{out}/training_sets").count()
    n_test = inp.test.count()
    assert preds.count() == n_test
    sets = spark.read.parquet(f"{out}/training_sets")
    per = sets.groupBy("fold", "is_attributed").count().collect()
    n_pos = inp.train.filter("is_attributed = 1").count()
    assert sorted(r["count"] for r in per) == [n_pos] * 4
    assert len(sets.columns) == 180 + 4
    assert spark.read.parquet(f"{out}/test_set").count() == n_test
    ens = spark.read.option("header", True).csv(f"{out}/predictions/ensemble")
    assert ens.count() == n_test and ens.filter(F.col("is_attributed").isNull()).count() == 0
    # the same training sets through tables bucketed by row id
    before = sorted(tuple(r) for r in spark.read.parquet(f"{out}/training_sets").collect())
    prefix = "pipe_" + uuid.uuid4().hex[:8]
    pipeline.features(spark, out, buckets=4, table_prefix=prefix)
    pipeline.folds(spark, out, n_folds=2, buckets=4, table_prefix=prefix)
    pipeline.training_sets(spark, out, table_prefix=prefix)
    after = sorted(tuple(r) for r in spark.read.parquet(f"{out}/training_sets").collect())
    assert after == before
