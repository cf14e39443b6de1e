"""Listings: search, filters, pages, sort orders, ownership, public columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns each listing may show; secrets and vectors are in none of them.
PUBLIC = {
    "users": ["id", "email", "full_name", "role", "is_active", "is_verified", "is_suspended", "created_at", "last_login_at"],
    "documents": ["id", "knowledge_base_id", "name", "file_type", "language", "status", "status_detail",
                  "processing_progress_pct", "original_size_bytes", "page_count", "chunk_count", "created_at", "updated_at"],
    "knowledge_bases": ["id", "parent_folder_id", "name", "description", "color", "icon", "tags", "is_archived", "is_folder",
                        "document_count", "total_chunk_count", "storage_bytes_used", "created_at", "updated_at"],
    "chat_sessions": ["id", "knowledge_base_id", "title", "is_pinned", "is_archived", "is_bookmarked", "created_at", "updated_at"],
    "chat_messages": ["id", "role", "content", "confidence_score", "latency_ms", "created_at"],
    "api_usage_logs": ["id", "user_id", "endpoint", "model", "latency_ms", "status_code", "error_message", "created_at"],
    "audit_logs": ["id", "user_id", "action", "resource_type", "resource_id", "created_at"],
}


def public(df: DataFrame, name: str) -> DataFrame:
    return df.select(*PUBLIC[name])


def contains_text(col: str, needle: str | None) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the needle stay wildcards, no needle admits all."""
    return F.ilike(F.col(col), F.lit(f"%{needle}%")) if needle else F.lit(True)


def search(df: DataFrame, column: str, needle: str | None = None, equals: dict[str, object] | None = None) -> DataFrame:
    out = df.filter(contains_text(column, needle)) if needle else df
    for name, value in (equals or {}).items():
        if value:
            out = out.filter(F.col(name) == value)
    return out


def visible(df: DataFrame, include_archived: bool = False) -> DataFrame:
    return df if include_archived else df.filter(~F.col("is_archived"))


def newest(df: DataFrame, ts: str, tie: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first with the id as last key; a page is a top-n, not a full sort."""
    ordered = df.orderBy(F.desc(ts), F.asc(tie))
    return ordered if limit is None else ordered.offset(offset).limit(limit)


def pinned_first(df: DataFrame, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc("is_pinned"), F.desc("updated_at"), F.asc(tie))


def errors(usage: DataFrame) -> DataFrame:
    return usage.filter(F.col("status_code") >= 400)


def owned(requests: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with ``owned``: whether their (id, owner) exists. Each input is read and joined once."""
    known = table.select(*keys).distinct().withColumn("owned", F.lit(True))
    return requests.join(known, keys, "left").withColumn("owned", F.coalesce("owned", F.lit(False)))


def processing_by(documents: DataFrame, key: str) -> DataFrame:
    """Whether anything is still being processed."""
    from lorewell.functions.rules import is_still_processing

    return documents.groupBy(key).agg(
        F.bool_or(is_still_processing("status")).alias("still_processing"),
        F.count_if(is_still_processing("status")).alias("n_processing"),
    )
