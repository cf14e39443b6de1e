"""Counters that follow the changes of documents instead of being recounted.

A change carries the row before and after it; either is null where the row did not exist. Both
images are counted, the old one with a minus, so inserts, updates, moves and deletes are one sum,
and the order of changes does not matter. The summary has a row per knowledge base and status.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.operators.analytics import usage_window

KEYS = ["kb_id", "status"]
SUMS = ["documents", "size_bytes", "chunk_count"]
IMAGE = "struct<kb_id:string,owner_id:string,status:string,size_bytes:bigint,chunk_count:bigint>"
SUMMARY = "kb_id string, owner_id string, status string, documents long, size_bytes long, chunk_count long"


def _summed(rows: DataFrame) -> DataFrame:
    """Sums per key, combined before the shuffle; a key that has come to nothing has no row."""
    out = rows.groupBy("kb_id", "owner_id", "status").agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
    return out.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in SUMS]))


def delta(changes: DataFrame) -> DataFrame:
    """What ``changes(before, after)``, both of type ``IMAGE``, add to the summary. Null sizes and counts are zero."""

    def image(name: str, sign: int) -> Column:
        of = F.col(name)
        counted = [(F.lit(sign) * F.coalesce(of[c], F.lit(0))).cast("long").alias(c) for c in SUMS[1:]]
        return F.when(of.isNotNull(), F.struct(of["kb_id"].alias("kb_id"), of["owner_id"].alias("owner_id"), of["status"].alias("status"), F.lit(sign).cast("long").alias("documents"), *counted))

    return _summed(changes.select(F.explode(F.array_compact(F.array(image("before", -1), image("after", 1)))).alias("i")).select("i.*"))


def merged(*parts: DataFrame) -> DataFrame:
    """One summary of several; it is as large as there are keys, whatever the documents."""
    return _summed(reduce(DataFrame.unionByName, parts))


def facts(documents: DataFrame) -> DataFrame:
    """The same summary recounted from ``documents(kb_id, owner_id, status, size_bytes, chunk_count)``."""
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMS[1:]]
    return _summed(documents.select("kb_id", "owner_id", "status", F.lit(1).cast("long").alias("documents"), *counted))


def correction(summary: DataFrame, recounted: DataFrame) -> DataFrame:
    """The delta that turns ``summary`` into ``recounted``; empty if nothing drifted."""
    return merged(recounted, summary.select("kb_id", "owner_id", "status", *[(-F.col(c)).alias(c) for c in SUMS]))


def _status_map() -> Column:
    # one entry per status; a document without a status is counted but has no key
    entry = F.when(F.col("status").isNotNull(), F.struct("status", "documents"))
    return F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("documents_by_status")


def knowledge_base_counters(summary: DataFrame) -> DataFrame:
    """Counters and status map per knowledge base; ``document_count`` counts completed documents."""
    per_status = summary.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
    done = F.when(F.col("status") == "completed", F.col("documents")).otherwise(0)
    return per_status.groupBy("kb_id").agg(
        F.sum(done).alias("document_count"), F.sum("size_bytes").alias("storage_bytes_used"), F.sum("chunk_count").alias("total_chunk_count"), _status_map())


def dashboard(summary: DataFrame, users: DataFrame, sessions: DataFrame, usage: DataFrame, as_of: Column) -> DataFrame:
    """The one-row dashboard of ``analytics.analytics_summary`` from the summary: neither documents nor chunks are read."""
    zero = F.lit(0).cast("long")
    totals = summary.agg(
        F.count_distinct("kb_id", "owner_id").alias("total_knowledge_bases"), F.coalesce(F.sum("chunk_count"), zero).alias("total_chunks"),
        F.coalesce(F.sum("size_bytes"), zero).alias("total_storage_bytes"), F.coalesce(F.sum("documents"), zero).alias("total_documents"))
    statuses = summary.groupBy("status").agg(F.sum("documents").alias("documents")).agg(_status_map())
    parts = [
        users.agg(F.count("*").alias("total_users")), totals, statuses, sessions.agg(F.count("*").alias("total_chat_sessions")),
        usage_window(usage, as_of).withColumnsRenamed({"api_calls": "api_calls_last_24h", "api_errors": "api_errors_last_24h"}),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])
