"""Row-level preparation: cut-off, union, raw features, splits and checks
(P2-P11, U1, A8 helpers)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import CLICK_ID, ID_COLUMNS, LABEL, NOT_MODELLED, ROW_ID, SPLIT, TIME, raw_name
from ..sources.clicks import BLOCK, FILE, UNION_ID_OFFSET


def last_click_time(df: DataFrame, time_col: str = TIME):
    """The latest click time: a one-value aggregate (the only thing collected)."""
    return df.agg(F.max(time_col).alias("t")).first()["t"]


def after_cutoff(test: DataFrame, train: DataFrame, time_col: str = TIME) -> DataFrame:
    """Test rows at or after the last training click (P2). A tie at the boundary is
    kept, so that click is in both sets. The bound becomes a literal, so the
    filter reaches the Parquet scan of ``test``."""
    cut = last_click_time(train, time_col)
    if cut is None:
        return test
    return test.filter(F.col(time_col) >= F.lit(cut))


def union_clicks(train: DataFrame, test: DataFrame, id_offset: int = UNION_ID_OFFSET,
                 test_id_col: str = CLICK_ID) -> DataFrame:
    """Outer union of train and test (U1): columns missing on a side become null;
    ``split`` tells the sides apart; a test row's ``row_id`` is its click id plus
    ``id_offset``, so every test row sorts after every train row on ties (P8)."""
    tr = train.withColumn(SPLIT, F.lit("train"))
    if ROW_ID not in tr.columns:
        raise ValueError("train needs a row_id column")
    te = test.withColumn(SPLIT, F.lit("test")).withColumn(ROW_ID, F.col(test_id_col) + F.lit(id_offset))
    return tr.unionByName(te, allowMissingColumns=True)


def with_file_order_ids(placed: DataFrame, snapshot_path: str) -> DataFrame:
    """Row ids 0, 1, 2, ... in file order (P8) for rows read with their place.

    Spark deals splits to tasks by size, so task order is not file order. A split
    is read whole by one task, so the per-task numbers of its rows are
    consecutive; rows and numbers are written once to ``snapshot_path``, then each
    split's numbers are shifted to the rows of all splits before it (by file
    path, then place in the file). The table of splits has one row per input
    split; the rows are joined to it, not ranked.
    """
    placed.withColumn("__at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(snapshot_path)
    rows = placed.sparkSession.read.parquet(snapshot_path)
    splits = rows.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(FILE, BLOCK, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    return (rows.join(splits, [FILE, BLOCK]).withColumn(ROW_ID, F.col("__at") + F.col("__shift"))
            .drop(FILE, BLOCK, "__at", "__shift"))


def write_sorted(df: DataFrame, path: str, by: Sequence[str], partition: str | None = None) -> None:
    """Rows in the order of ``by`` as output (O1, O2): file after file (by name) and row after row the order goes on, within
    each value of ``partition`` if given (a folder each). A range partitioning, then a sort in every task."""
    cols = [*([partition] if partition else []), *by]
    w = df.repartitionByRange(*[F.col(c) for c in cols]).sortWithinPartitions(*cols).write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def with_places(spark, path: str, partition: str | None = None) -> DataFrame:
    """Rows of :func:`write_sorted` with ``place``, their number (from 0) in the order of the files and of the rows in each.

    What a reader of the files sees, not what a sort would give. One row per file is ranked.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    by = [partition] if partition else []
    files = rows.groupBy(*by, "__file").agg(F.count(F.lit(1)).alias("__n"))
    w = (Window.partitionBy(partition) if partition else Window).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__file", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    return rows.join(files, "__file").withColumn("place", F.col("__before") + F.col("__at")).drop("__file", "__at", "__before")


def take_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of one side of the union."""
    return df.filter(F.col(SPLIT) == split)


def raw_features(df: DataFrame, cols: Sequence[str] = ID_COLUMNS, keep: Sequence[str] = (ROW_ID,)) -> DataFrame:
    """Each input column again as ``raw_<name>`` (P5)."""
    return df.select(*keep, *[F.col(c).alias(raw_name(c)) for c in cols])


def split_by_label(df: DataFrame, label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """(positives, negatives)."""
    return df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)


def drop_features(names: Iterable[str], drop: Iterable[str] = NOT_MODELLED) -> list[str]:
    """Feature list without the ids that are not modelled."""
    drop = set(drop)
    return [n for n in names if n not in drop]


def require_features(df: DataFrame, names: Iterable[str]) -> None:
    """Every requested feature column is present, else raise naming the missing ones."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
