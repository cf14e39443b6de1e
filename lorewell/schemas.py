"""Table contracts: explicit types, allowed values and length rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
_TAGS = T.ArrayType(T.StringType())
_VEC = T.ArrayType(T.FloatType(), containsNull=False)
_STAMPS = [("created_at", _TS), ("updated_at", _TS)]


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


BLOCKS = _struct(
    ("doc_id", _S), ("seq", _L), ("kind", _S), ("text", _S), ("heading_level", _I),
    ("page_number", _I), ("section_title", _S),
)
CHUNKS = _struct(
    ("chunk_id", _S), ("doc_id", _S), ("kb_id", _S), ("owner_id", _S), ("chunk_index", _I),
    ("page_number", _I), ("section", _S), ("content", _S), ("token_count", _I),
    ("embedding", _VEC), ("embedding_model", _S), ("checksum", _S),
    # copied from the document, so that a search needs no join
    ("document_name", _S), ("language", _S), ("document_created_at", _TS), ("created_at", _TS),
)
TABLES: dict[str, T.StructType] = {
    "users": _struct(
        ("id", _S), ("email", _S), ("full_name", _S), ("role", _S), ("auth_provider", _S), ("external_id", _S),
        ("is_active", _B), ("is_verified", _B), ("is_suspended", _B), ("last_login_at", _TS), *_STAMPS,
    ),
    "refresh_tokens": _struct(
        ("id", _S), ("user_id", _S), ("token_hash", _S), ("expires_at", _TS), ("revoked", _B),
        ("replaced_by_token_hash", _S), *_STAMPS,
    ),
    "knowledge_bases": _struct(
        ("id", _S), ("owner_id", _S), ("parent_folder_id", _S), ("name", _S), ("description", _S), ("color", _S),
        ("icon", _S), ("tags", _TAGS), ("is_archived", _B), ("is_folder", _B), ("document_count", _L),
        ("total_chunk_count", _L), ("storage_bytes_used", _L), *_STAMPS,
    ),
    "documents": _struct(
        ("id", _S), ("knowledge_base_id", _S), ("owner_id", _S), ("name", _S), ("file_type", _S), ("language", _S),
        ("status", _S), ("status_detail", _S), ("processing_progress_pct", _I), ("checksum", _S), ("version", _I),
        ("original_size_bytes", _L), ("page_count", _I), ("chunk_count", _L), ("embedding_model", _S),
        ("temp_storage_key", _S), ("extra_metadata", _S), *_STAMPS,
    ),
    "document_chunks": CHUNKS,
    "chat_sessions": _struct(
        ("id", _S), ("owner_id", _S), ("knowledge_base_id", _S), ("title", _S), ("is_pinned", _B),
        ("is_archived", _B), ("is_bookmarked", _B), ("share_token", _S), *_STAMPS,
    ),
    "chat_messages": _struct(
        ("id", _S), ("session_id", _S), ("parent_message_id", _S), ("role", _S), ("content", _S), ("model_used", _S),
        ("input_tokens", _I), ("output_tokens", _I), ("latency_ms", _I), ("confidence_score", _D),
        ("is_active_branch", _B), *_STAMPS,
    ),
    "chat_citations": _struct(
        ("id", _S), ("message_id", _S), ("document_id", _S), ("chunk_id", _S), ("document_name", _S),
        ("page_number", _I), ("section", _S), ("similarity_score", _D), ("excerpt", _S), *_STAMPS,
    ),
    "api_usage_logs": _struct(
        ("id", _S), ("user_id", _S), ("endpoint", _S), ("model", _S), ("input_tokens", _I), ("output_tokens", _I),
        ("latency_ms", _I), ("estimated_cost_usd", _D), ("status_code", _I), ("error_message", _S), *_STAMPS,
    ),
    "audit_logs": _struct(
        ("id", _S), ("user_id", _S), ("action", _S), ("resource_type", _S), ("resource_id", _S), ("ip_address", _S),
        ("user_agent", _S), ("metadata_json", _S), *_STAMPS,
    ),
}

# The lower-case enum members stored in the tables.
ALLOWED = {
    ("users", "role"): ["admin", "user", "ai"],
    ("documents", "status"): [
        "pending", "virus_scanning", "extracting", "ocr_processing", "chunking", "embedding", "completed", "failed",
    ],
    ("chat_messages", "role"): ["user", "assistant", "system"],
}
# Longest text each column may hold.
MAX_LENGTH = {("document_chunks", "section"): 512, ("chat_citations", "section"): 512}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast to the table's schema; absent columns become NULL, undeclared ones are an error."""
    have = set(df.columns)
    if unknown := sorted(have - {f.name for f in TABLES[name].fields}):
        raise ValueError(f"{name} has no columns {', '.join(unknown)}")
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TABLES[name].fields
    ])


def rule_violation(name: str) -> Column:
    """Comma-joined names of the columns of a row that break a value or length rule; NULL when none does."""
    checks = [
        F.when(F.col(col).isNotNull() & ~F.col(col).isin(values), F.lit(col))
        for (tab, col), values in ALLOWED.items() if tab == name
    ] + [
        F.when(F.char_length(col) > limit, F.lit(col))
        for (tab, col), limit in MAX_LENGTH.items() if tab == name
    ]
    if not checks:
        return F.lit(None).cast("string")
    joined = F.concat_ws(",", *checks)
    return F.when(joined != "", joined)
