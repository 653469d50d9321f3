"""Session helpers: the settings every plan in this package assumes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the feature plans rely on. Time zone UTC: click times are UTC wall
# clock. AQE: coalesces small shuffles, splits skewed join partitions at run time.
# Runtime bloom filters: a join of the few fold ids with the wide feature table
# prunes the feature rows before they are shuffled.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small fold-id side -> bloom filter on the big feature side before its shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "clickfeat", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package settings.

    On a cluster pass ``master=None`` and let spark-submit decide; tests and the
    bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local-mode session without the
    setting (tests) gets a fresh scratch folder; on a cluster a missing setting
    is an error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...)")
    path = tempfile.mkdtemp(prefix="clickfeat-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def reliable_checkpoint(df):
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage
    (never a local checkpoint: it would not survive a lost executor)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def use_session_time_zone_utc(spark: SparkSession) -> None:
    """Pin the session time zone the feature plans assume (date parts, epochs)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
