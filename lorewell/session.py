"""Session settings and the few physical-layout decisions shared by all jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hint only when its measured payload is below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # Row cap plus byte cap: long documents must not make huge Arrow batches.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; on a cluster only ``SETTINGS`` matter."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lorewell")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_settings(spark: SparkSession) -> None:
    """Runtime settings for a session that was built elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; on a
    cluster a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lorewell-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, for a table that several jobs read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for iterative jobs whose plan would otherwise grow."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_small_scan(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a scan of fewer splits than cores before CPU-heavy work.

    A large table is already spread over the cluster and is left alone, so no
    shuffle is added at scale. ``df`` must be a plain scan: its splits are counted.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= width:
        return df
    return df.repartition(width, key)


def fits_broadcast(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Measure a side before hinting a broadcast; the caller has another route when this is False."""
    return df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()["b"] <= limit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
