"""The whole batch pipeline, step by step, from click CSVs to prediction CSVs.

Each step reads what the previous one wrote (Parquet under ``out``), so a lost
executor or a failed step costs at most that step, and every step can be re-run
alone:

1. ``ingest``        typed CSV scan, row id fixed at ingest, epoch seconds, cut-off (S1-S3, P1, P2, P8);
   ``dev_sample`` optionally writes seeded small copies (M1, O1)
2. ``features``      union of train and partial supplement, all six families (U1, S4)
3. ``folds``         balanced folds + hold-out flag, labels per fold (M1-M4, S9)
4. ``training_sets`` folds joined once with the features, written by fold (M5-M7, J3-J5)
5. ``test_set``      new test ids mapped to supplement rows, their features (J2, M8)
6. ``models``        one boosted-tree model per fold, scored and averaged (L1-L4, A7, S7, S11)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.datetime import with_epoch_seconds
from ..operators import folds as fo
from ..operators import model as mo
from ..operators.prep import (after_cutoff, drop_features, require_features, take_split, union_clicks,
                              with_file_order_ids, write_sorted)
from ..operators.testmap import map_test_ids, test_feature_set
from ..schema import CLICK_ID, LABEL, ROW_ID, SPLIT
from ..session import reliable_checkpoint
from ..sources.clicks import read_clicks_test, read_clicks_train
from .features import build_features, manifest_names, read_bucketed_features, read_features, write_bucketed


def ingest(spark: SparkSession, train_csv, supplement_csv, test_csv, out: str) -> None:
    """Typed CSVs to Parquet. The train row id is given once at ingest, in file
    order, and persisted with the rows; it is never recomputed after a shuffle."""
    train = with_file_order_ids(with_epoch_seconds(read_clicks_train(spark, train_csv, place=True)), f"{out}/train_placed")
    train.write.mode("overwrite").parquet(f"{out}/train")
    train = spark.read.parquet(f"{out}/train")
    supp = with_epoch_seconds(read_clicks_test(spark, supplement_csv))
    after_cutoff(supp, train).write.mode("overwrite").parquet(f"{out}/supplement_partial")
    read_clicks_test(spark, test_csv).write.mode("overwrite").parquet(f"{out}/test")


def dev_sample(spark: SparkSession, out: str, fraction: float = 0.001, seed: int = 114514) -> None:
    """Development copies of the three ingested sets: exactly ``round(fraction * rows)`` rows of each, in click order from
    file to file (M1, O1)."""
    for name in ("train", "supplement_partial", "test"):
        key = ROW_ID if name == "train" else CLICK_ID
        write_sorted(fo.sample_fraction(spark.read.parquet(f"{out}/{name}"), fraction, seed, key), f"{out}/{name}_small", ["click_time", key])


def id_offset(spark: SparkSession, out: str) -> int:
    """The first row id after the train rows (one value): supplement ids start there."""
    last = spark.read.parquet(f"{out}/train").agg(F.max(ROW_ID)).first()[0]
    return 0 if last is None else last + 1


def union_of(spark: SparkSession, out: str) -> DataFrame:
    return union_clicks(spark.read.parquet(f"{out}/train"), spark.read.parquet(f"{out}/supplement_partial"),
                        id_offset(spark, out))


def features(spark: SparkSession, out: str, buckets: int | None = None, table_prefix: str | None = None) -> None:
    """All families; with ``buckets`` + ``table_prefix`` as catalog tables bucketed by row id."""
    build_features(union_of(spark, out), f"{out}/features", buckets=buckets, table_prefix=table_prefix)


def folds(spark: SparkSession, out: str, n_folds: int = 10, valid_fraction: float = 0.15, seed: int = 1234,
          buckets: int | None = None, table_prefix: str | None = None) -> None:
    train = take_split(union_of(spark, out), "train")
    table = fo.train_valid_split(fo.balanced_folds(train, n_folds), valid_fraction, seed)
    # each fold's rows in id order from file to file (O2): tight Parquet statistics on row_id
    write_sorted(table, f"{out}/folds", [ROW_ID], "fold")
    if buckets and table_prefix:
        write_bucketed(table, f"{table_prefix}_folds", buckets)


def training_sets(spark: SparkSession, out: str, table_prefix: str | None = None) -> None:
    """Folds joined once with the features. With bucketed tables (``table_prefix``)
    the family joins and the fold join read co-located buckets: no shuffle."""
    names = manifest_names()
    if table_prefix:
        feats = read_bucketed_features(spark, table_prefix, names)
        fold_table = spark.table(f"{table_prefix}_folds")
    else:
        fold_table = spark.read.parquet(f"{out}/folds")
        feats = read_features(spark, f"{out}/features", names, ids=fold_table)
    require_features(feats, names)
    rows = fo.fold_features(fold_table, feats)
    check = fo.check_alignment(fold_table, rows, ["fold", ROW_ID]).first()
    if check["only_left"] or check["only_right"]:
        raise RuntimeError(f"fold ids and feature rows disagree: {check.asDict()}")
    (fo.training_set(rows, names, keys=("fold", ROW_ID, "is_valid")).sortWithinPartitions(ROW_ID)
     .write.mode("overwrite").partitionBy("fold").parquet(f"{out}/training_sets"))


def test_set(spark: SparkSession, out: str) -> None:
    names = manifest_names()
    offset = id_offset(spark, out)
    ids = reliable_checkpoint(map_test_ids(spark.read.parquet(f"{out}/test"), spark.read.parquet(f"{out}/supplement_partial")))
    asked = ids.select((F.col("old_click_id") + F.lit(offset)).alias(ROW_ID))
    feats = read_features(spark, f"{out}/features", names, ids=asked)
    test_feature_set(ids, feats, names, offset).write.mode("overwrite").parquet(f"{out}/test_set")


def models(spark: SparkSession, out: str, params: mo.BoostParams | None = None) -> DataFrame:
    """Fit one model per fold, save them, write each model's and the mean's predictions."""
    names = drop_features(manifest_names())
    sets = spark.read.parquet(f"{out}/training_sets")
    fitted = mo.train_bagged_gbt(sets, names, params)
    mo.save_models(fitted, f"{out}/models")
    test = spark.read.parquet(f"{out}/test_set")
    long = reliable_checkpoint(mo.predict_long(fitted, test, names))
    mo.write_predictions(long.withColumnRenamed("score", LABEL), f"{out}/predictions", by="fold")
    mean = mo.ensemble_mean(long)
    mo.write_predictions(mean, f"{out}/predictions/ensemble")
    return spark.read.parquet(f"{out}/test_set").select(CLICK_ID).join(mean, CLICK_ID, "left")


def run_all(spark: SparkSession, train_csv, supplement_csv, test_csv, out: str, n_folds: int = 10,
            params: mo.BoostParams | None = None) -> DataFrame:
    ingest(spark, train_csv, supplement_csv, test_csv, out)
    features(spark, out)
    folds(spark, out, n_folds)
    training_sets(spark, out)
    test_set(spark, out)
    return models(spark, out, params)
