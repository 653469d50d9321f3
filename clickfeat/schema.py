"""Schemas, column roles and feature naming rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

# Fixed values that must equal the reference's data model.
ID_COLUMNS = ("ip", "app", "device", "os", "channel")  # key order inside every feature name
TIME = "click_time"
SECONDS = "click_time_int_seconds"
LABEL = "is_attributed"
ATTRIBUTED_TIME = "attributed_time"
CLICK_ID = "click_id"
ROW_ID = "row_id"
SPLIT = "split"
DAY_SECONDS = 86400

# The ten date parts, and the six of them that are modelled.
DATE_TIME_PARTS = ("year", "month", "weekday", "day", "hour", "minute", "second",
                   "hour_of_day", "hour_of_day_sin", "hour_of_day_cos")
MODELLED_DATE_TIME = ("weekday", "hour", "minute", "hour_of_day", "hour_of_day_sin", "hour_of_day_cos")
# Raw feature family in its published order; four of them are not modelled.
RAW_FEATURES = ("raw_channel", "raw_ip", "raw_app", "raw_device", "raw_os")
NOT_MODELLED = ("raw_channel", "raw_ip", "raw_device", "raw_os")
CATEGORICAL_FEATURES = ("weekday", "hour", "minute")
# The two forward windows (seconds) of the published count families.
RANGE_1H = (0, 3600)
RANGE_6H = (0, 21600)

TRAIN_SCHEMA = T.StructType([
    T.StructField("ip", T.LongType(), False),
    T.StructField("app", T.IntegerType(), False),
    T.StructField("device", T.IntegerType(), False),
    T.StructField("os", T.IntegerType(), False),
    T.StructField("channel", T.IntegerType(), False),
    T.StructField(TIME, T.TimestampType(), False),
    T.StructField(ATTRIBUTED_TIME, T.TimestampType(), True),
    T.StructField(LABEL, T.IntegerType(), False),
])

TEST_SCHEMA = T.StructType([
    T.StructField(CLICK_ID, T.LongType(), False),
    T.StructField("ip", T.LongType(), False),
    T.StructField("app", T.IntegerType(), False),
    T.StructField("device", T.IntegerType(), False),
    T.StructField("os", T.IntegerType(), False),
    T.StructField("channel", T.IntegerType(), False),
    T.StructField(TIME, T.TimestampType(), False),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField(CLICK_ID, T.LongType(), False),
    T.StructField(LABEL, T.DoubleType(), True),
])


def as_keys(keys: str | Iterable[str]) -> tuple[str, ...]:
    """Normalise a key argument: a bare string is one key, never its letters."""
    if isinstance(keys, str):
        return (keys,)
    out = tuple(keys)
    if not out:
        raise ValueError("a feature combination needs at least one key")
    return out


def canonical(keys: Iterable[str], order: Sequence[str] = ID_COLUMNS) -> tuple[str, ...]:
    """Keys in the fixed naming order; unknown keys keep their given order at the end."""
    keys = as_keys(keys)
    known = [k for k in order if k in keys]
    return tuple(known + [k for k in keys if k not in order])


def gap_name(keys, direction: str) -> str:
    if direction not in ("forward", "backward"):
        raise ValueError(f"direction must be 'forward' or 'backward', got {direction!r}")
    return "_".join(as_keys(keys)) + "_dt_" + direction


def count_name(keys) -> str:
    return "count_groupby_" + "_".join(as_keys(keys))


def range_count_name(keys, back: int, fwd: int) -> str:
    return f"{count_name(keys)}_in_time_range_{back}_{fwd}_seconds"


def unique_count_name(objective: str, keys) -> str:
    return f"unique_count_{objective}_groupby_" + "_".join(as_keys(keys))


def raw_name(col: str) -> str:
    return "raw_" + col
