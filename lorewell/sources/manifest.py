"""File manifests: type, acceptance, size, storage key, content signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import rules


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of a folder. Content is not selected, so files are listed but not read.

    Spark file scans skip files without a single byte; those have no row here.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return with_file_types(found.select("path", name.alias("name"), "length", "modificationTime"))


def with_file_types(manifest: DataFrame, name: str = "name") -> DataFrame:
    return manifest.withColumn("extension", rules.extension(name)).withColumn("file_type", rules.file_type(name))


def quality_gate(manifest: DataFrame, name: str = "name", size: str = "length") -> DataFrame:
    return manifest.withColumn("reject_reason", rules.upload_rejection(name, size))


def confirm_sizes(registered: DataFrame, stored: DataFrame, key: str = "storage_key") -> DataFrame:
    """Stored object size wins over the size the client reported."""
    actual = stored.select(key, F.col("length").alias("_actual"))
    return (
        registered.join(actual, key, "left")
        .withColumn("size_mismatch", F.col("_actual") != F.col("original_size_bytes"))
        .withColumn("missing", F.col("_actual").isNull())
        .withColumn("original_size_bytes", F.coalesce("_actual", "original_size_bytes"))
        .drop("_actual")
    )


def confirm_uploads(documents: DataFrame, requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only pending documents may be confirmed; other requests keep a reason."""
    known = documents.select(key, "status")
    return requests.join(known, key, "left").select(
        *requests.columns, "status",
        F.when(F.col("status").isNull(), F.lit("not found"))
        .when(F.col("status") != "pending", F.concat(F.lit("already "), F.col("status"))).alias("reject_reason"),
        F.when(F.col("status") == "pending", F.lit("virus_scanning")).otherwise(F.col("status")).alias("next_status"),
        F.when(F.col("status") == "pending", F.lit(5)).alias("progress"),
    )


def expired_uploads(stored: DataFrame, completed: DataFrame, as_of: Column, days: int = 7, key: str = "storage_key") -> DataFrame:
    """Originals older than ``days`` whose document never completed."""
    old = stored.filter(F.col("modificationTime") < as_of - F.make_interval(days=F.lit(days)))
    return old.join(completed.select(key), key, "left_anti")
