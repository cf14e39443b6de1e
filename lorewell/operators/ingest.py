"""Ingest outcome per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY_DETAIL = "No extractable text content found"


def finalise(documents: DataFrame, chunks: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Chunk counts and final status; ``failures(doc_id, reason)`` come from the readers."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("tokens"))
    out = documents.join(counts, "doc_id", "left")
    if failures is not None:
        out = out.join(failures.groupBy("doc_id").agg(F.min("reason").alias("_reason")), "doc_id", "left")
    else:
        out = out.withColumn("_reason", F.lit(None).cast("string"))
    done = F.col("chunk_count").isNotNull() & F.col("_reason").isNull()
    zero = F.lit(0).cast("long")
    return out.withColumns({
        "status": F.when(done, "completed").otherwise("failed"),
        "status_detail": F.when(~done, F.coalesce("_reason", F.lit(EMPTY_DETAIL))),
        "processing_progress_pct": F.when(done, 100).otherwise(0),
        "chunk_count": F.coalesce("chunk_count", zero), "tokens": F.coalesce("tokens", zero),
    }).drop("_reason")
