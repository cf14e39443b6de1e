"""Usage log, dashboard, rate windows and alarms as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorewell.operators.analytics import ALARM_PERIODS, ALARM_THRESHOLD, ERROR_STATUS
from lorewell.sources.tables import usage_log_rows

DASHBOARD_REFRESH = "30 seconds"


def append_usage(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Logged requests appended as Parquet."""
    return (
        usage_log_rows(requests).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def endpoint_counts(requests: DataFrame) -> DataFrame:
    """Calls and errors per endpoint, for a complete-mode dashboard."""
    return usage_log_rows(requests).groupBy("endpoint").agg(
        F.count("*").alias("api_calls"), F.count_if(F.col("status_code") >= ERROR_STATUS).alias("api_errors"))


def status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count("*").alias("n_documents"))


def start_dashboard(counts: DataFrame, path: str, checkpoint: str, refresh: str | None = DASHBOARD_REFRESH) -> StreamingQuery:
    """A small stored table for a screen, replaced with each batch; without ``refresh`` it runs once over what is there."""
    writer = (
        counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch: df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path))
    )
    return writer.trigger(processingTime=refresh).start() if refresh else writer.trigger(availableNow=True).start()


def start_versioned_dashboard(counts: DataFrame, path: str, checkpoint: str, refresh: str | None = DASHBOARD_REFRESH, keep: int = 3) -> StreamingQuery:
    """As ``start_dashboard``, but each batch writes a version of its own, so a reader never meets a half-replaced table.

    The marker that Spark's commit puts into a version last is the pointer: a version without it is not
    there yet. The newest ``keep`` versions stay for readers that have opened one.
    """

    def publish(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/version={batch}")
        files = _files(df.sparkSession, path)
        for version in _published(df.sparkSession, path)[:-keep]:
            files.delete(_path(df.sparkSession, f"{path}/version={version}"), True)

    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return writer.trigger(processingTime=refresh).start() if refresh else writer.trigger(availableNow=True).start()


def read_dashboard(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version, or nothing before the first."""
    versions = _published(spark, path)
    return spark.read.parquet(f"{path}/version={versions[-1]}") if versions else None


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _published(spark: SparkSession, path: str) -> list[int]:
    found = _files(spark, path).globStatus(_path(spark, f"{path}/version=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or ())


def rate_windows(requests: DataFrame, keys: list[str], limit: int, ts: str = "ts", window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Clock-aligned windows over the limit, emitted once final."""
    return (
        requests.withWatermark(ts, late).groupBy(*keys, F.window(ts, window).alias("w"))
        .agg(F.count("*").alias("n_requests")).filter(F.col("n_requests") > limit)
        .select(*keys, F.col("w.start").alias("window_start"), "n_requests")
    )


def error_alarms(
    log: DataFrame, is_error: Column, ts: str = "ts", period_minutes: int = 5, threshold: int = ALARM_THRESHOLD,
    periods: int = ALARM_PERIODS, late: str = "10 minutes",
) -> DataFrame:
    """Two chained windows: errors per period, then breaching periods per run of ``periods``."""
    counts = (
        log.filter(is_error).withWatermark(ts, late)
        .groupBy(F.window(ts, f"{period_minutes} minutes").alias("w")).agg(F.count("*").alias("n_errors"))
    )
    runs = counts.filter(F.col("n_errors") > threshold).groupBy(
        F.window("w", f"{period_minutes * periods} minutes", f"{period_minutes} minutes").alias("run")
    ).agg(F.count("*").alias("n_breaching"))
    last_period = F.col("run.end") - F.make_dt_interval(mins=F.lit(period_minutes))
    return runs.filter(F.col("n_breaching") == periods).select(last_period.alias("alarm_at"))
