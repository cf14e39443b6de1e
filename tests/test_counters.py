"""Counters folded from changes against counters recounted from the rows."""

import os
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lorewell.operators import analytics, counters
from lorewell.plans import views
from lorewell.session import table
from lorewell.streaming import counters as stored

FEED = f"before {counters.IMAGE}, after {counters.IMAGE}"


def _life(seed, steps):
    """Random inserts, updates, moves and deletes, and the rows that are left."""
    rnd, rows, changes = random.Random(seed), {}, []
    for _ in range(steps):
        key = rnd.randrange(12)
        before = rows.get(key)
        image = (f"kb{rnd.randrange(3)}", "own", rnd.choice(["pending", "completed", "failed", None]), rnd.choice([None, 0, 5, 70]), rnd.choice([None, 0, 2]))
        after = None if before is not None and rnd.random() < 0.3 else image
        rows[key] = after
        changes.append((before, after))
    return changes, [r for r in rows.values() if r is not None]


def _rows(df):
    return sorted(map(tuple, df.select("kb_id", "owner_id", "status", *counters.SUMS).collect()), key=str)


def test_batches_add_up_to_the_facts(spark, tmp_path):
    path = str(tmp_path)
    changes, left = _life(3, 90)
    for batch in range(9):
        part = spark.createDataFrame(changes[batch * 10 : batch * 10 + 10][::-1], FEED)  # order within a batch does not matter
        for _ in range(1 + batch % 2):  # a repeated attempt replaces its folder
            stored.write_delta(part, path, batch)
        if batch in (2, 5, 7):
            stored.compact(spark, path, batch)
    facts = counters.facts(spark.createDataFrame(left, "kb_id string, owner_id string, status string, size_bytes long, chunk_count long"))
    summary = stored.read_counters(spark, path)
    assert _rows(summary) == _rows(facts) and left
    assert counters.correction(summary, facts).count() == 0
    # what an older base held is gone, the rest is there for readers of the base before
    assert sorted(os.listdir(f"{path}/base")) == ["n=5", "n=7"] and sorted(os.listdir(f"{path}/delta")) == ["n=6", "n=7", "n=8"]


def test_half_written_batches_are_not_read(spark, tmp_path):
    path = str(tmp_path)
    assert stored.read_counters(spark, path).count() == 0
    stored.write_delta(spark.createDataFrame([(None, ("kb", "own", "completed", 7, 1))], FEED), path, 0)
    stored.write_delta(spark.createDataFrame([(None, ("kb", "own", "completed", 9, 1))], FEED), path, 1)
    os.remove(f"{path}/delta/n=1/_SUCCESS")
    assert _rows(stored.read_counters(spark, path)) == [("kb", "own", "completed", 1, 7, 1)]


def test_drift_is_found_and_mended(spark):
    facts = spark.createDataFrame([("a", "o", "completed", 3, 30, 6), ("b", "o", None, 1, 0, 0)], counters.SUMMARY)
    wrong = spark.createDataFrame([("a", "o", "completed", 4, 30, 6), ("c", "o", "failed", 1, 2, 0)], counters.SUMMARY)
    fix = counters.correction(wrong, facts)
    assert _rows(fix) == [("a", "o", "completed", -1, 0, 0), ("b", "o", None, 1, 0, 0), ("c", "o", "failed", -1, -2, 0)]
    assert _rows(counters.merged(wrong, fix)) == _rows(facts)
    drift = analytics.counter_drift(*[counters.knowledge_base_counters(s) for s in (wrong, facts)], ["document_count", "total_chunk_count"])
    assert [(r.kb_id, r.drift_document_count) for r in drift.collect()] == [("a", 1)]


def test_stream_resumes_between_bases(spark, tmp_path):
    changes, left = _life(8, 60)
    for batch in range(6):
        spark.createDataFrame(changes[batch * 10 : batch * 10 + 10], FEED).write.mode("append").parquet(f"{tmp_path}/in")
        feed = spark.readStream.schema(FEED).parquet(f"{tmp_path}/in")
        stored.start_counters(feed, f"{tmp_path}/out", f"{tmp_path}/progress", compact_every=4).awaitTermination()
    facts = counters.facts(spark.createDataFrame(left, "kb_id string, owner_id string, status string, size_bytes long, chunk_count long"))
    assert _rows(stored.read_counters(spark, f"{tmp_path}/out")) == _rows(facts)
    assert os.listdir(f"{tmp_path}/out/base") == ["n=3"]


def test_dashboard_reads_counters_only(spark, tmp_path):
    path = str(tmp_path)
    stored.write_delta(spark.createDataFrame([(None, ("kb", "own", "completed", 7, 2))], FEED), path, 0)
    out = counters.dashboard(
        stored.read_counters(spark, path), table(spark, SF_SMALL, "customer"), views.sessions(spark, SF_SMALL), views.usage(spark, SF_SMALL), F.lit("2024-02-01").cast("timestamp_ntz"))
    row = out.first()
    assert (row.total_documents, row.total_chunks, row.total_storage_bytes, row.documents_by_status) == (1, 2, 7, {"completed": 1})
    assert not any("documents.parquet" in f for f in out.inputFiles())
    empty = counters.dashboard(
        spark.createDataFrame([], counters.SUMMARY), table(spark, SF_SMALL, "customer"), views.sessions(spark, SF_SMALL), views.usage(spark, SF_SMALL), F.lit("2024-02-01").cast("timestamp_ntz")).first()
    assert (empty.total_documents, empty.total_chunks, empty.documents_by_status) == (0, 0, {})


def test_chat_queries_read_stored_chunks(spark):
    from __spark_entry__ import queries

    scanned = queries()["context_prompt"](spark, SF_SMALL).inputFiles()
    assert any("/chunks-" in f for f in scanned) and not any("documents.parquet" in f for f in scanned)
