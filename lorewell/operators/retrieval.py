"""Tenant-scoped retrieval for a whole batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators.similarity import top_k_join
from lorewell.session import fits_broadcast

TOP_K = 8
MIN_SIMILARITY = 0.72
TENANT = ["kb_id", "owner_id"]
# Memory of one broadcast (question, rank, chunk id, score) row.
HIT_BYTES = 160
# Distinct tenants up to which the chunk scans get a list of them as a filter; it is at most this many values.
LISTED_TENANTS = 1000
_FILTERS = ["doc_ids", "language", "uploaded_after", "uploaded_before"]


def _of_tenants(chunks: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of the asked tenants only, for ranking and for showing.

    Both scans get the knowledge bases as a plain filter, which prunes the folders of
    a table stored by ``kb_id``; more tenants than fit a list are matched by a semi join alone.
    """
    tenants = questions.select(*TENANT).distinct()
    listed = tenants.limit(LISTED_TENANTS + 1).collect()
    if len(listed) > LISTED_TENANTS:
        return chunks.join(tenants, TENANT, "left_semi"), chunks
    pruned = chunks.where(F.col(TENANT[0]).isin([r[0] for r in listed]))
    return pruned.join(F.broadcast(tenants), TENANT, "left_semi"), pruned


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    top_k: int = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
    dimension: int | None = None,
) -> DataFrame:
    """``hits(query_id, rank, chunk_id, doc_id, document_name, content, page_number, section, similarity)``.

    The tenant keys are join keys and cannot be left out; chunks of other tenants are
    dropped before their vectors are packed. Per-question filters are used when the
    questions carry their columns; dates are those of the document, stored with the
    chunk as ``document_created_at`` or taken from ``documents``. Ranking reads ids and
    vectors only; content and names are joined to the few kept rows.
    """
    filtered = any(c in questions.columns for c in _FILTERS)
    chunks, listed = _of_tenants(chunks, questions)
    searchable = chunks.select(*TENANT, "chunk_id", "doc_id", "embedding")
    asked = questions
    if filtered:
        types = {"doc_ids": f"array<{chunks.schema['doc_id'].dataType.simpleString()}>", "language": "string",
                 "uploaded_after": "timestamp", "uploaded_before": "timestamp"}
        for name in _FILTERS:
            if name not in asked.columns:
                asked = asked.withColumn(name, F.lit(None).cast(types[name]))
        if {"language", "document_created_at"} <= set(chunks.columns):
            searchable = chunks.select(*TENANT, "chunk_id", "doc_id", "embedding", "language", F.col("document_created_at").alias("created_at"))
        else:
            searchable = searchable.join(documents.select("doc_id", "language", "created_at"), "doc_id")
    # hits are at most top_k per question; joined by broadcast, the content
    # of the corpus stays where it is
    hit_bytes = F.lit(top_k * HIT_BYTES).cast("long")
    few = fits_broadcast(asked, hit_bytes)
    ranked = top_k_join(asked, searchable, TENANT, top_k, min_similarity, filtered, dimension=dimension)
    named = "document_name" in chunks.columns
    shown = listed.select("chunk_id", "doc_id", "content", "page_number", "section", *(["document_name"] if named else []))
    hits = shown.join(F.broadcast(ranked) if few else ranked, "chunk_id")
    if not named:
        hits = hits.join(documents.select("doc_id", F.col("name").alias("document_name")), "doc_id")
    return (
        hits.select("query_id", "rank", "chunk_id", "doc_id", "document_name", "content", "page_number", "section", "similarity")
    )


def scoped_filter(
    chunks: DataFrame,
    kb_id: str,
    owner_id: str,
    doc_ids: list | None = None,
    language: str | None = None,
    uploaded_after=None,
    uploaded_before=None,
) -> DataFrame:
    """The same predicates for one tenant, as pushed-down filters on the chunk scan."""
    out = chunks.filter((F.col("kb_id") == kb_id) & (F.col("owner_id") == owner_id))
    if doc_ids:
        out = out.filter(F.col("doc_id").isin(doc_ids))
    if language:
        out = out.filter(F.col("language") == language)
    if uploaded_after is not None:
        out = out.filter(F.col("created_at") >= F.lit(uploaded_after))
    if uploaded_before is not None:
        out = out.filter(F.col("created_at") <= F.lit(uploaded_before))
    return out


def outcomes(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Answered or not, per question: no hit means no answer, confidence 0.0, no model call."""
    per_question = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.max("similarity").alias("confidence"))
    return questions.select("query_id").join(per_question, "query_id", "left").select(
        "query_id",
        F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"),
        F.when(F.col("n_hits").isNull(), "no_answer").otherwise("answered").alias("outcome"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
