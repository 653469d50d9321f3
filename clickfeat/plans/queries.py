"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the
``events`` table of that folder re-read as clicks (FIXTURES.md B)."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.datetime import date_time_features, with_epoch_seconds
from ..operators import folds as fo
from ..operators import model as mo
from ..operators import trees
from ..operators.combos import feature_combinations
from ..operators.gaps import click_gaps
from ..operators.groups import class_counts, cube_counts, group_click_count, time_bounds, unique_counts
from ..operators.metrics import auc
from ..operators.prep import after_cutoff, drop_features, raw_features, require_features, take_split, union_clicks, with_places, write_sorted
from ..operators.ranges import count_in_range, count_in_range_for
from ..operators.testmap import map_test_ids, test_feature_set
from ..schema import (CLICK_ID, DATE_TIME_PARTS, ID_COLUMNS, LABEL, ROW_ID, SECONDS, SPLIT, TIME)
from ..session import ensure_checkpoint_dir, reliable_checkpoint, use_session_time_zone_utc
from ..sources.clicks import (SUPPLEMENT_START, TRAIN_END, UNION_ID_OFFSET, read_clicks_test, read_clicks_train, read_events_clicks,
                              snapshot, supplement_clicks, test_clicks, train_clicks, write_clicks_csv)
from .features import FAMILIES, build_features, feature_manifest, feature_table, manifest_names, read_features, read_manifest

ALL = feature_combinations(ID_COLUMNS)
WITH_IP = feature_combinations(ID_COLUMNS, include=["ip"])
# Fixed values of the published pipeline: 10 folds (seeds 0-9), development sample
# 0.001 with seed 114514, hold-out 15 % with seed 1234.
N_FOLDS = 10
SAMPLE_SEED = 114514
SAMPLE_FRACTION = 0.001
SPLIT_SEED = 1234
VALID_FRACTION = 0.15
# Our own choices for the W5 probe query and the AUC query.
PROBE_KEYS = ("ip", "app")
PROBE_RANGE = (-3600, 3600)
AUC_SCORES = ID_COLUMNS  # raw ids scored as if they were model outputs


def rounded(df: DataFrame, places: int = 5) -> DataFrame:
    """Float columns rounded to ``places`` as double (engines differ in the last bits)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the reliable checkpoint folder (shared on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Inputs:
    """The train / supplement / test / union views of one folder (built lazily)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        # the clicks view reads wall-clock event times as UTC (FIXTURES.md B)
        use_session_time_zone_utc(spark)
        self.clicks = read_events_clicks(spark, sf_dir)
        self.train = train_clicks(read_events_clicks(spark, sf_dir, ts_before=TRAIN_END)).drop(CLICK_ID)
        self.supplement = supplement_clicks(read_events_clicks(spark, sf_dir, ts_from=SUPPLEMENT_START))
        self._partial = None
        self._union = None

    @property
    def partial(self) -> DataFrame:
        if self._partial is None:
            self._partial = after_cutoff(self.supplement, self.train)
        return self._partial

    @property
    def union(self) -> DataFrame:
        if self._union is None:
            self._union = union_clicks(self.train, self.partial)
        return self._union

    @property
    def test(self) -> DataFrame:
        return test_clicks(self.supplement)


# --- sources / projections -------------------------------------------------------

def q_csv_roundtrip(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    base = scratch_dir(spark, "csv_roundtrip")
    write_clicks_csv(inp.train.select("ip", "app", "device", "os", "channel", TIME, "attributed_time", LABEL),
                     f"{base}/train")
    write_clicks_csv(inp.supplement.select(CLICK_ID, "ip", "app", "device", "os", "channel", TIME),
                     f"{base}/supplement")
    tr = read_clicks_train(spark, f"{base}/train")
    te = read_clicks_test(spark, f"{base}/supplement")
    snapshot(tr, f"{base}/train_parquet")
    tr = spark.read.parquet(f"{base}/train_parquet")
    cols = ["ip", "app", "device", "os", "channel"]
    a = tr.select(F.lit("train").alias(SPLIT), F.lit(None).cast("bigint").alias(CLICK_ID), *cols,
                  F.unix_timestamp(TIME).alias("click_seconds"),
                  F.unix_timestamp("attributed_time").alias("attributed_seconds"), F.col(LABEL))
    b = te.select(F.lit("test").alias(SPLIT), F.col(CLICK_ID), *cols, F.unix_timestamp(TIME).alias("click_seconds"),
                  F.lit(None).cast("bigint").alias("attributed_seconds"), F.lit(None).cast("int").alias(LABEL))
    return a.unionByName(b)


def q_raw_features(spark, sf_dir):
    u = Inputs(spark, sf_dir).union
    return raw_features(u, keep=[ROW_ID, SPLIT]).select(ROW_ID, SPLIT, "raw_channel", "raw_ip", "raw_app",
                                                        "raw_device", "raw_os")


def q_epoch_seconds(spark, sf_dir):
    u = Inputs(spark, sf_dir).union.drop(SECONDS)
    return with_epoch_seconds(u).select(ROW_ID, SPLIT, SECONDS)


def q_date_time_features(spark, sf_dir):
    u = Inputs(spark, sf_dir).union
    return rounded(date_time_features(u.select(ROW_ID, SPLIT, TIME), TIME, DATE_TIME_PARTS).drop(TIME))


def q_cutoff_union(spark, sf_dir):
    u = Inputs(spark, sf_dir).union
    return u.select(ROW_ID, SPLIT, CLICK_ID, *ID_COLUMNS, SECONDS, LABEL)


def q_time_bounds(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    tr = time_bounds(inp.train).select(F.lit("train").alias(SPLIT), "first_second", "last_second", "n_rows")
    te = time_bounds(take_split(inp.union, "test")).select(F.lit("test").alias(SPLIT), "first_second",
                                                           "last_second", "n_rows")
    return tr.unionByName(te)


# --- keyed families ----------------------------------------------------------------

def _keyed_base(spark, sf_dir):
    # ``split`` stays out of the window chain (a string in every sort); it is a
    # function of the row id and comes back at the end
    return Inputs(spark, sf_dir).union.select(ROW_ID, *ID_COLUMNS, SECONDS)


def _features_only(df: DataFrame) -> DataFrame:
    split = F.when(F.col(ROW_ID) >= F.lit(UNION_ID_OFFSET), F.lit("test")).otherwise(F.lit("train"))
    feats = [c for c in df.columns if c not in (ROW_ID, *ID_COLUMNS, SECONDS)]
    return rounded(df.select(ROW_ID, split.alias(SPLIT), *feats))


def q_click_gaps_forward(spark, sf_dir):
    return _features_only(click_gaps(_keyed_base(spark, sf_dir), ALL, "forward"))


def q_click_gaps_backward(spark, sf_dir):
    return _features_only(click_gaps(_keyed_base(spark, sf_dir), ALL, "backward"))


def q_click_gaps_both(spark, sf_dir):
    # true gaps (no day wrap) in both directions for the combinations holding ip
    return _features_only(click_gaps(_keyed_base(spark, sf_dir), WITH_IP, "both", wrap_days=False))


def q_click_gaps_all(spark, sf_dir):
    return _features_only(click_gaps(_keyed_base(spark, sf_dir), ALL, "both"))


def q_group_click_count(spark, sf_dir):
    return _features_only(group_click_count(_keyed_base(spark, sf_dir), ALL))


def q_cube_counts(spark, sf_dir):
    return cube_counts(_keyed_base(spark, sf_dir), ID_COLUMNS)


def q_unique_counts_ip(spark, sf_dir):
    return _features_only(unique_counts(_keyed_base(spark, sf_dir), [("ip",)]))


def q_unique_counts_all(spark, sf_dir):
    return _features_only(unique_counts(_keyed_base(spark, sf_dir), ALL))


def q_count_in_range_1h(spark, sf_dir):
    return _features_only(count_in_range(_keyed_base(spark, sf_dir), WITH_IP, 0, 3600))


def q_count_in_range_6h(spark, sf_dir):
    return _features_only(count_in_range(_keyed_base(spark, sf_dir), WITH_IP, 0, 21600))


def q_count_in_range_back(spark, sf_dir):
    return _features_only(count_in_range(_keyed_base(spark, sf_dir), WITH_IP, -3600, 0))


def q_count_in_range_probes(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    probes = inp.test.select(CLICK_ID, *PROBE_KEYS, F.unix_timestamp(TIME).cast("int").alias(SECONDS))
    events = inp.union.select(*PROBE_KEYS, SECONDS)
    out = count_in_range_for(probes, events, PROBE_KEYS, *PROBE_RANGE, name="n_events")
    return out.select(CLICK_ID, "n_events")


# --- sampling and training sets -----------------------------------------------------

def q_sample_fraction(spark, sf_dir):
    u = Inputs(spark, sf_dir).union
    return fo.sample_fraction(u, SAMPLE_FRACTION, SAMPLE_SEED).select(ROW_ID, SPLIT, SECONDS)


def q_time_order(spark, sf_dir):
    """Rows written in click order and read back: the place of each over all files (O1)."""
    path = scratch_dir(spark, "time_order")
    write_sorted(Inputs(spark, sf_dir).union.select(ROW_ID, SPLIT, SECONDS), path, [SECONDS, ROW_ID])
    return with_places(spark, path).select(ROW_ID, SPLIT, SECONDS, "place")


def q_fold_order(spark, sf_dir):
    """Fold rows written in id order, a folder per fold, and read back: the place of each in its fold (O2)."""
    path = scratch_dir(spark, "fold_order")
    write_sorted(_folds(Inputs(spark, sf_dir)), path, [ROW_ID], "fold")
    return with_places(spark, path, "fold").select(F.col("fold").cast("int").alias("fold"), ROW_ID, LABEL, "place")


def q_class_counts(spark, sf_dir):
    return class_counts(Inputs(spark, sf_dir).train)


def _folds(inp: Inputs) -> DataFrame:
    return fo.balanced_folds(take_split(inp.union, "train"), N_FOLDS)


def q_balanced_folds(spark, sf_dir):
    return _folds(Inputs(spark, sf_dir))


def q_train_valid_split(spark, sf_dir):
    return fo.train_valid_split(_folds(Inputs(spark, sf_dir)), VALID_FRACTION, SPLIT_SEED)


def _written_features(inp: Inputs) -> tuple[str, list[str]]:
    """Folder of the feature table, written per family to the shared scratch folder, and its names."""
    path = scratch_dir(inp.spark, "features")
    build_features(inp.union, path)
    return path, manifest_names(read_manifest(inp.spark, f"{path}/manifest"))


def _fold_rows(inp: Inputs, path: str, names: list[str], folds: DataFrame) -> DataFrame:
    feats = read_features(inp.spark, path, names, ids=folds)
    require_features(feats, names)
    return fo.fold_features(folds, feats)


def _test_rows(inp: Inputs, path: str, names: list[str]) -> DataFrame:
    ids = reliable_checkpoint(map_test_ids(inp.test, inp.partial))
    asked = ids.select((F.col("old_click_id") + F.lit(UNION_ID_OFFSET)).alias(ROW_ID))
    return test_feature_set(ids, read_features(inp.spark, path, names, ids=asked), names)


def q_fold_training_set(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    path, names = _written_features(inp)
    return rounded(fo.training_set(_fold_rows(inp, path, names, _folds(inp)), names))


def q_alignment_check(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    folds = _folds(inp)
    feats = feature_table(inp.union, ("raw",))
    labelled = fo.fold_features(folds, feats.drop(LABEL))
    return fo.check_alignment(folds, labelled, ["fold", ROW_ID])


def q_test_id_map(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    return map_test_ids(inp.test, inp.partial)


def q_test_feature_set(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    return rounded(_test_rows(inp, *_written_features(inp)))


def q_auc_of_score(spark, sf_dir):
    train = Inputs(spark, sf_dir).train
    stacked = train.select(LABEL, F.explode(F.array(*[
        F.struct(F.lit("raw_" + c).alias("feature"), F.col(c).cast("double").alias("score")) for c in AUC_SCORES
    ])).alias("s")).select(F.col("s.feature").alias("feature"), F.col("s.score").alias("score"), LABEL)
    return auc(stacked, "score", LABEL, ["feature"]).select(
        "feature", F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


# --- models (no SQL oracle) ------------------------------------------------------------

MODEL_FAMILIES = FAMILIES


def _stored_folds(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` written once, a folder per fold: fitting a fold reads its own files, and of them the columns it needs."""
    path = scratch_dir(spark, "fold_rows")
    rows.write.partitionBy("fold").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def _model_inputs(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    path, names = _written_features(inp)
    folds = reliable_checkpoint(fo.train_valid_split(_folds(inp), VALID_FRACTION, SPLIT_SEED))
    return inp, path, drop_features(names), _stored_folds(spark, _fold_rows(inp, path, names, folds))


def q_bagged_gbt_auc(spark, sf_dir):
    """Per fold: hold-out AUC of its model; fold -1: AUC of the mean score of each row that some model
    holds out, over those models."""
    inp, path, modelled, rows = _model_inputs(spark, sf_dir)
    models = mo.train_bagged_gbt(rows, modelled)
    scored = reliable_checkpoint(mo.holdout_scores(models, rows, modelled)).select("fold", ROW_ID, LABEL, "score")
    pooled = scored.groupBy(ROW_ID, LABEL).agg(F.avg("score").alias("score")).withColumn("fold", F.lit(-1))
    return auc(scored.unionByName(pooled), "score", LABEL, ["fold"]).select("fold", "auc", "n_pos", "n_neg")


def q_fold_dataset(spark, sf_dir):
    """The saved model-ready folds, read back: rows and vector widths per fold, hold-out flag and label."""
    inp, path, modelled, rows = _model_inputs(spark, sf_dir)
    saved = scratch_dir(spark, "fold_dataset")
    mo.save_fold_dataset(rows, modelled, saved)
    width = F.size(vector_to_array(F.col("features")))
    return (spark.read.parquet(saved).groupBy(F.col("fold").cast("int").alias("fold"), "is_valid", F.col(LABEL).cast("int").alias(LABEL))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min(width).alias("least_features"), F.max(width).alias("most_features")))


def q_holdout_scores(spark, sf_dir):
    """Each fold's hold-out rows under its model, from the node table cut at the best round."""
    inp, path, modelled, rows = _model_inputs(spark, sf_dir)
    models, nodes, _ = mo.train_with_patience(spark, rows, modelled, scratch_dir(spark, "nodes"))
    out = mo.predict_nodes(models, nodes, rows.filter("is_valid"), modelled, mo.BoostParams(), [ROW_ID, LABEL], "fold")
    return out.select(F.col("model").alias("fold"), ROW_ID, LABEL, "score")


def q_early_stop(spark, sf_dir):
    """Per fold: rounds trained, the round at which patience cuts its model, and the hold-out loss there."""
    inp, path, modelled, rows = _model_inputs(spark, sf_dir)
    _, _, best = mo.train_with_patience(spark, rows, modelled, scratch_dir(spark, "nodes"))
    return best.select(F.col("model").alias("fold"), "n_rounds", "best_round", "loss")


def q_node_scores(spark, sf_dir):
    """Hold-out rows of small models: does the node table give the score of the saved and reloaded model?"""
    inp, path, modelled, rows = _model_inputs(spark, sf_dir)
    params = mo.BoostParams(max_iter=3, max_depth=4)
    models = mo.train_bagged_gbt(rows.filter(~F.col("is_valid")), modelled, params, validation_col=None)
    saved = scratch_dir(spark, "models")
    mo.save_models(models, saved)
    loaded = mo.load_models(saved, sorted(models))
    nodes = reliable_checkpoint(trees.write_nodes(spark, loaded, f"{saved}/nodes"))
    valid = rows.filter("is_valid")
    ours = mo.predict_nodes(loaded, nodes, valid, modelled, params, [ROW_ID], "fold").withColumnsRenamed({"model": "fold", "score": "ours"})
    theirs = mo.holdout_scores(loaded, rows, modelled)
    both = theirs.join(ours, ["fold", ROW_ID], "full")
    same = F.coalesce(F.abs(F.col("score") - F.col("ours")) < 1e-9, F.lit(False))
    return both.select("fold", ROW_ID, LABEL, same.alias("same_score"), F.col("ours").between(0.0, 1.0).alias("is_probability"))


def q_cross_validate(spark, sf_dir):
    """Fold 0 cross-validated: mean AUC after every round, and the best round."""
    inp, path, modelled, rows = _model_inputs(spark, sf_dir)
    fold0 = rows.filter(F.col("fold") == 0)
    out = mo.cross_validate(fold0, modelled, scratch_dir(spark, "cv"), n_folds=5)
    return out.select(F.lit(0).alias("fold"), F.lit(5).alias("cv_folds"), "round", "mean_auc", "n_models", "is_best")


def q_predict_ensemble(spark, sf_dir):
    inp, path, modelled, rows = _model_inputs(spark, sf_dir)
    models, nodes, _ = mo.train_with_patience(spark, rows, modelled, scratch_dir(spark, "nodes"))
    test = _test_rows(inp, path, modelled)
    return mo.ensemble_mean(mo.predict_nodes(models, nodes, test, modelled, mo.BoostParams()))


def fold_score(fold_col: str = "fold") -> F.Column:
    """A deterministic stand-in model score per fold, from the raw ids."""
    return 1.0 / (1.0 + F.exp(-(F.col("raw_app").cast("double") - F.col(fold_col).cast("double") * 0.25
                                 + F.col("raw_os").cast("double") * 0.1)))


def q_ensemble_mean(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    feats = feature_table(inp.union, ("raw",))
    test = test_feature_set(map_test_ids(inp.test, inp.partial), feats, ["raw_app", "raw_os"])
    base = scratch_dir(spark, "predictions")
    scored = test.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(N_FOLDS - 1))))
    mo.write_predictions(scored.select("fold", CLICK_ID, fold_score().alias(LABEL)), base, by="fold")
    back = mo.read_predictions(spark, base).withColumnRenamed(LABEL, "score")
    return mo.ensemble_mean(back).select(CLICK_ID, F.round(LABEL, 9).alias(LABEL))


QUERIES = {
    "csv_roundtrip": q_csv_roundtrip,
    "raw_features": q_raw_features,
    "epoch_seconds": q_epoch_seconds,
    "date_time_features": q_date_time_features,
    "cutoff_union": q_cutoff_union,
    "time_bounds": q_time_bounds,
    "click_gaps_forward": q_click_gaps_forward,
    "click_gaps_backward": q_click_gaps_backward,
    "click_gaps_both": q_click_gaps_both,
    "click_gaps_all": q_click_gaps_all,
    "group_click_count": q_group_click_count,
    "cube_counts": q_cube_counts,
    "unique_counts_ip": q_unique_counts_ip,
    "unique_counts_all": q_unique_counts_all,
    "count_in_range_1h": q_count_in_range_1h,
    "count_in_range_6h": q_count_in_range_6h,
    "count_in_range_back": q_count_in_range_back,
    "count_in_range_probes": q_count_in_range_probes,
    "sample_fraction": q_sample_fraction,
    "time_order": q_time_order,
    "fold_order": q_fold_order,
    "class_counts": q_class_counts,
    "balanced_folds": q_balanced_folds,
    "train_valid_split": q_train_valid_split,
    "fold_training_set": q_fold_training_set,
    "alignment_check": q_alignment_check,
    "test_id_map": q_test_id_map,
    "test_feature_set": q_test_feature_set,
    "auc_of_score": q_auc_of_score,
    "ensemble_mean": q_ensemble_mean,
    "fold_dataset": q_fold_dataset,
    "bagged_gbt_auc": q_bagged_gbt_auc,
    "holdout_scores": q_holdout_scores,
    "early_stop": q_early_stop,
    "node_scores": q_node_scores,
    "cross_validate": q_cross_validate,
    "predict_ensemble": q_predict_ensemble,
}
