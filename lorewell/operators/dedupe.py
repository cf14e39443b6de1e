"""Repeated content by checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import checksum


def checksum_groups(df: DataFrame, scope: list[str], ident: str, content: str) -> DataFrame:
    """Copies per scope and checksum with the id kept. Counts and the smallest
    id combine before the shuffle, so a large group of copies costs one row per task."""
    return (
        df.select(*scope, ident, checksum(content).alias("checksum"))
        .groupBy(*scope, "checksum")
        .agg(F.min(ident).alias("keep_id"), F.count("*").alias("copies"))
    )


def drop_copies(df: DataFrame, scope: list[str], ident: str, content: str) -> DataFrame:
    """First row (by id) of every distinct content within a scope."""
    keep = checksum_groups(df, scope, ident, content).select(F.col("keep_id").alias(ident))
    return df.join(keep, ident, "left_semi")
