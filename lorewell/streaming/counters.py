"""A stored summary that a stream of changes keeps up to date.

Each batch writes what it adds to a folder of its own, which a repeated attempt overwrites, so no
change counts twice. Every ``compact_every`` batches the folders are added up into a new base.
Spark's commit marker makes a folder visible: a reader takes the newest whole base and the whole
deltas after it, and never waits for or meets a half-written one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorewell.operators import counters
from lorewell.streaming.usage import _files, _path

COMPACT_EVERY = 16


def _whole(spark: SparkSession, path: str) -> list[int]:
    found = _files(spark, path).globStatus(_path(spark, f"{path}/n=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or ())


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(counters.SUMMARY).parquet(*paths)


def write_delta(changes: DataFrame, path: str, batch: int) -> None:
    """Store what one batch of changes adds; the same batch again replaces it."""
    counters.delta(changes).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/delta/n={batch}")


def read_counters(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The summary after all whole batches, or after batch ``upto``."""
    within = lambda n: upto is None or n <= upto
    base = [n for n in _whole(spark, f"{path}/base") if within(n)][-1:]
    later = [n for n in _whole(spark, f"{path}/delta") if within(n) and (not base or n > base[0])]
    paths = [f"{path}/base/n={n}" for n in base] + [f"{path}/delta/n={n}" for n in later]
    return counters.merged(_read(spark, paths)) if paths else spark.createDataFrame([], counters.SUMMARY)


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Add up all batches to ``upto`` into a base, and drop what the base before it already held.

    The deltas between the two bases stay, for readers that have opened the older one.
    """
    older = [n for n in _whole(spark, f"{path}/base") if n < upto]
    read_counters(spark, path, upto).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/base/n={upto}")
    files = _files(spark, path)
    for n in older[:-1]:
        files.delete(_path(spark, f"{path}/base/n={n}"), True)
    for n in _whole(spark, f"{path}/delta"):
        if older and n <= older[-1]:
            files.delete(_path(spark, f"{path}/delta/n={n}"), True)


def start_counters(changes: DataFrame, path: str, checkpoint: str, refresh: str | None = None, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Fold a stream of ``changes(before, after)`` into the summary at ``path``; without ``refresh`` it runs once over what is there."""

    def fold(df: DataFrame, batch: int) -> None:
        write_delta(df, path, batch)
        if (batch + 1) % compact_every == 0 and batch not in _whole(df.sparkSession, f"{path}/base"):
            compact(df.sparkSession, path, batch)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)
    return writer.trigger(processingTime=refresh).start() if refresh else writer.trigger(availableNow=True).start()
