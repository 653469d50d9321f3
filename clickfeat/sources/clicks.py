"""Click sources: typed CSV ingest (S1, S2), snapshots (S3) and the ``clicks``
view over the ``events`` table used by tests and the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.datetime import epoch_seconds
from ..schema import (ATTRIBUTED_TIME, CLICK_ID, LABEL, ROW_ID, SECONDS, SPLIT, TEST_SCHEMA, TIME,
                      TRAIN_SCHEMA)

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Fixed values of the clicks view over ``events`` (FIXTURES.md part B).
EVENT_TYPE_APP = {"click": 0, "error": 1, "purchase": 2, "signup": 3}  # any other type: 4
TRAIN_END = "2024-01-22 00:00:00"        # train: click_time < this
SUPPLEMENT_START = "2024-01-21 22:00:00"  # supplement: click_time >= this
TEST_START = "2024-01-24 00:00:00"        # test: supplement clicks in [TEST_START, TEST_END)
TEST_END = "2024-01-29 00:00:00"
TEST_ID_OFFSET = 1_000_000                # new test click id = click id + this
UNION_ID_OFFSET = 1_000_000_000_000       # row id of a supplement row in the union = click id + this
# Where a row stands in its input: file and start of the split it was read in.
FILE, BLOCK = "__file", "__block"


def _read_by_header(spark: SparkSession, path, schema: T.StructType, place: bool = False) -> DataFrame:
    """Columns of ``schema`` by the names in the files' header, whatever their order; a missing one raises.
    With ``place`` also each row's file and split start."""
    names = spark.read.option("header", True).csv(path).columns
    missing = [n for n in schema.names if n not in names]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    in_file = T.StructType([schema[n] if n in schema.names else T.StructField(n, T.StringType()) for n in names])
    where = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK)] if place else []
    return (spark.read.schema(in_file).option("header", True).option("enforceSchema", False)
            .option("timestampFormat", TIME_FORMAT).option("mode", "FAILFAST").csv(path).select(*schema.names, *where))


def read_clicks_train(spark: SparkSession, path, place: bool = False) -> DataFrame:
    """Training clicks: 8 named columns, declared types, two time columns."""
    return _read_by_header(spark, path, TRAIN_SCHEMA, place)


def read_clicks_test(spark: SparkSession, path) -> DataFrame:
    """Test or supplement clicks: ``click_id`` first, no label."""
    return _read_by_header(spark, path, TEST_SCHEMA)


def write_clicks_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("timestampFormat", TIME_FORMAT).csv(path))


def snapshot(df: DataFrame, path: str, partition_by=None) -> None:
    """Columnar snapshot between steps (S3); also cuts the lineage for the next step."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def clicks_from_events(events: DataFrame) -> DataFrame:
    """The ``clicks`` view: events re-read as labelled ad clicks (FIXTURES.md B).

    Columns: row_id, click_id, ip, app, device, os, channel, click_time,
    click_time_int_seconds, is_attributed, attributed_time.
    """
    app = F.lit(4)
    for name, code in reversed(list(EVENT_TYPE_APP.items())):
        app = F.when(F.col("event_type") == name, F.lit(code)).otherwise(app)
    cents = F.round(F.col("value") * 100).cast("bigint")
    click_time = F.date_trunc("second", F.col("ts").cast("timestamp"))
    base = events.select(
        F.col("event_id").alias(ROW_ID),
        F.col("event_id").alias(CLICK_ID),
        F.col("user_id").cast("bigint").alias("ip"),
        app.cast("int").alias("app"),
        (cents % 3).cast("int").alias("device"),
        (cents % 7).cast("int").alias("os"),
        F.expr("cast(get_json_object(props, '$.k') as int) div 10").cast("int").alias("channel"),
        click_time.alias(TIME),
    )
    attributed = (F.col("app") == 2) & (F.col("channel") < 2) & (F.col("os") < 3)
    return base.select(
        "*",
        epoch_seconds(F.col(TIME)).cast("int").alias(SECONDS),
        F.when(attributed, 1).otherwise(0).cast("int").alias(LABEL),
        F.when(attributed, F.col(TIME) + F.expr("INTERVAL 60 SECONDS")).alias(ATTRIBUTED_TIME),
    )


def read_events_clicks(spark: SparkSession, sf_dir: str, ts_from: str | None = None,
                       ts_before: str | None = None) -> DataFrame:
    """The clicks view of ``events``; optional whole-second bounds on the raw ``ts``
    (truncating to the second keeps both comparisons exact) reach the Parquet scan,
    so row groups outside the time slice are skipped."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if ts_from is not None:
        events = events.filter(F.col("ts") >= F.to_timestamp_ntz(F.lit(ts_from)))
    if ts_before is not None:
        events = events.filter(F.col("ts") < F.to_timestamp_ntz(F.lit(ts_before)))
    return clicks_from_events(events)


def train_clicks(clicks: DataFrame, end: str = TRAIN_END) -> DataFrame:
    """Labelled training clicks (the train file's 9 columns plus ids)."""
    return clicks.filter(F.col(TIME) < F.to_timestamp(F.lit(end)))


def supplement_clicks(clicks: DataFrame, start: str = SUPPLEMENT_START) -> DataFrame:
    """Unlabelled supplement clicks: click_id, ids, click_time, seconds."""
    return (clicks.filter(F.col(TIME) >= F.to_timestamp(F.lit(start)))
            .select(CLICK_ID, "ip", "app", "device", "os", "channel", TIME, SECONDS))


def test_clicks(supplement: DataFrame, start: str = TEST_START, end: str = TEST_END,
                id_offset: int = TEST_ID_OFFSET) -> DataFrame:
    """The final test set: a time slice of the supplement under new click ids."""
    t = F.col(TIME)
    return (supplement.filter((t >= F.to_timestamp(F.lit(start))) & (t < F.to_timestamp(F.lit(end))))
            .select((F.col(CLICK_ID) + F.lit(id_offset)).alias(CLICK_ID),
                    "ip", "app", "device", "os", "channel", TIME))
