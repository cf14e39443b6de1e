"""Shapes of physical plans that decide how the jobs behave on large data."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from __spark_entry__ import queries
from lorewell.operators import analytics, listing, retrieval, similarity
from lorewell.operators.chunking import chunk_blocks
from lorewell.plans import views
from lorewell.session import table
from lorewell.sources import plain
from lorewell.sources.tables import write_chunks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_pairwise_joins(spark, name):
    text = plan(queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ingest_needs_no_shuffle(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    text = plan(chunk_blocks(plain.markdown_blocks(docs), clustered=True))
    assert "Exchange" not in text and "Window" not in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_chunk_vectors_are_not_shuffled_when_questions_are_small(spark):
    ranked = similarity.top_k_join(views.topic_questions(spark, SF_SMALL), views.vector_chunks(spark, SF_SMALL), retrieval.TENANT, 8, 0.1)
    text = plan(ranked)
    above = text.index("BroadcastHashJoin")
    assert "WindowGroupLimit" in text and text.count("Partial") >= 1
    # the only exchange over the chunk side carries the kept pairs
    chunk_side = text[above:text.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in chunk_side


def test_large_question_sets_are_salted_not_broadcast(spark):
    ranked = similarity.top_k_join(
        views.topic_questions(spark, SF_SMALL), views.vector_chunks(spark, SF_SMALL), retrieval.TENANT, 8, 0.1, broadcast_limit=-1)
    logical = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in logical and "strategy=broadcast" not in logical


def test_content_is_joined_to_broadcast_hits(spark):
    chunks = views.encoded_chunks(spark, SF_SMALL)
    hits = retrieval.retrieve(views.chat_questions(spark, SF_SMALL), chunks, views.documents(spark, SF_SMALL), dimension=views.DIMENSION)
    text = plan(hits)
    assert text.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in text


def test_filters_reach_the_scan(spark):
    text = plan(listing.errors(table(spark, SF_SMALL, "events").withColumn("status_code", F.col("value").cast("int"))).select("event_id"))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
    text = plan(table(spark, SF_SMALL, "events").filter(analytics.since("ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))).select("user_id"))
    assert "GreaterThanOrEqual(ts" in text


def test_pages_are_top_n(spark):
    text = plan(listing.newest(table(spark, SF_SMALL, "events"), "ts", "event_id", 100, 50))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_history_limits_before_the_shuffle(spark):
    text = plan(queries()["history_last_n"](spark, SF_SMALL))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_retrieval_prunes_both_scans_of_a_stored_chunk_table(spark, tmp_path):
    """A question of one tenant opens that tenant's folders only, for vectors and for content."""
    chunks = views.encoded_chunks(spark, SF_SMALL).select(
        "chunk_id", "doc_id", "kb_id", "owner_id", "chunk_index", "page_number", "section", "content", "token_count", "embedding", "checksum", "document_name")
    path = str(tmp_path / "chunks")
    write_chunks(chunks, path)
    stored = spark.read.parquet(path)
    one = views.chat_questions(spark, SF_SMALL).where("kb_id = 'src3'")
    hits = retrieval.retrieve(one, stored, views.documents(spark, SF_SMALL), min_similarity=-1.0, dimension=views.DIMENSION)
    scans = [line for line in hits._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line and "kb_id" in line]
    assert len(scans) >= 2 and all("PartitionFilters: [kb_id" in s or "PartitionFilters: [isnotnull(kb_id" in s for s in scans), scans
    assert hits.count() > 0
    with pytest.raises(ValueError, match="no columns extra"):
        write_chunks(chunks.withColumn("extra", F.lit(1)), path)
