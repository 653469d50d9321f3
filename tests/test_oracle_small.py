"""Registered queries against their DuckDB oracle on the smallest folder."""
import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

from conftest import SF_SMALL

FAST = ["cutoff_union", "date_time_features", "click_gaps_all", "click_gaps_both", "unique_counts_all",
        "group_click_count", "cube_counts", "count_in_range_6h", "count_in_range_back", "count_in_range_probes",
        "balanced_folds", "train_valid_split", "test_id_map", "auc_of_score", "sample_fraction", "csv_roundtrip",
        "alignment_check", "ensemble_mean", "raw_features", "epoch_seconds", "time_bounds", "click_gaps_forward",
        "click_gaps_backward", "unique_counts_ip", "count_in_range_1h", "class_counts", "fold_training_set",
        "test_feature_set"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_SMALL)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 18 and df.count() > 0
