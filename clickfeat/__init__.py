"""clickfeat: click-event feature engineering, balanced folds and bagged trees as
Spark DataFrame plans."""

from .operators.combos import feature_combinations
from .operators.gaps import click_gaps, time_since_previous, time_to_next
from .operators.groups import class_counts, cube_counts, group_click_count, time_bounds, unique_counts
from .operators.ranges import count_in_range, count_in_range_for
from .operators.skew import KeyProfile, forced_profile, profile_keys
from .functions.datetime import date_time_features, with_epoch_seconds
from .plans.features import feature_manifest, feature_table
from .session import get_spark

__all__ = [
    "KeyProfile", "class_counts", "click_gaps", "count_in_range", "count_in_range_for", "cube_counts",
    "date_time_features", "feature_combinations", "feature_manifest", "feature_table", "forced_profile",
    "get_spark", "group_click_count", "profile_keys", "time_bounds", "time_since_previous", "time_to_next",
    "unique_counts", "with_epoch_seconds",
]
