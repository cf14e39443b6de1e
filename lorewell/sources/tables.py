"""Table sources and sinks: Parquet by default, JDBC for a live database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.schemas import TABLES, conform

# Request paths that are never logged.
UNLOGGED_PATHS = "^(/health|/docs|/openapi\\.json|/redoc)"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    conform(df, name).write.mode(mode).parquet(f"{root}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """Parallel read of a live table, split on a numeric key."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
        numPartitions=str(partitions), **options,
    )
    return reader.load()


def write_chunks(chunks: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Append chunk rows under ``kb_id=``.

    The rebalance hint sizes the files and splits a hot knowledge base over
    several tasks. With ``batch`` the rows go to a folder of their own that a
    repeated attempt overwrites, so a retry cannot double them.
    """
    rows = conform(chunks, "document_chunks").hint("rebalance", "kb_id")
    target, mode = (path, "append") if batch is None else (f"{path}/batch={batch}", "overwrite")
    rows.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("kb_id").parquet(target)


def usage_log_rows(requests: DataFrame) -> DataFrame:
    """Requests of known users outside the health and documentation paths."""
    return requests.filter(F.col("user_id").isNotNull() & ~F.rlike("endpoint", F.lit(UNLOGGED_PATHS)))
