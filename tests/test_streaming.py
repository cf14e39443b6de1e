"""Replayed streams must give the batch answers."""

import datetime as dt
import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lorewell.operators.analytics import error_alarm
from lorewell.operators.encoding import FeatureHashEncoder
from lorewell.operators.maintenance import transition_faults
from lorewell.operators.ratelimit import anchored_windows
from lorewell.session import table
from lorewell.streaming import ingest, stateful, usage

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _event_stream(spark, tmp_path, parts=4):
    """The events in time order, as files read one per batch."""
    events = table(spark, SF_SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = events.count()
    for i in range(parts):
        lo, hi = i * n // parts, (i + 1) * n // parts
        ranked = events.orderBy("ts", "event_id").offset(lo).limit(hi - lo)
        ranked.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        files = list((tmp_path / "in" / f"part={i}").glob("*.parquet"))
        (tmp_path / "flat").mkdir(exist_ok=True)
        for f in files:
            (tmp_path / "flat" / f"{i}.parquet").write_bytes(f.read_bytes())
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    return events, stream


def _run(stream, tmp_path, mode="append"):
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination(180)
    assert q.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_usage_append_equals_batch(spark, tmp_path):
    events, stream = _event_stream(spark, tmp_path)
    shape = lambda df: df.select(
        F.col("event_id").alias("id"), "user_id", F.concat(F.lit("/"), "event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"))
    q = usage.append_usage(shape(stream), str(tmp_path / "log"), str(tmp_path / "logcp"))
    q.awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()
    q = usage.start_dashboard(usage.endpoint_counts(shape(stream)), str(tmp_path / "dash"), str(tmp_path / "dashcp"), refresh=None)
    q.awaitTermination(180)
    got = {r["endpoint"]: (r["api_calls"], r["api_errors"]) for r in spark.read.parquet(str(tmp_path / "dash")).collect()}
    want = {r["endpoint"]: (r["n"], r["e"]) for r in shape(events).groupBy("endpoint").agg(
        F.count("*").alias("n"), F.count_if(F.col("status_code") >= 400).alias("e")).collect()}
    assert got == want


def test_dashboard_readers_see_whole_versions(spark, tmp_path):
    path = str(tmp_path / "dash")
    assert usage.read_dashboard(spark, path) is None
    _, stream = _event_stream(spark, tmp_path, parts=5)
    counts = stream.groupBy("event_type").agg(F.count("*").alias("n"))
    usage.start_versioned_dashboard(counts, path, str(tmp_path / "cp"), refresh=None, keep=2).awaitTermination(180)
    versions = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "dash").glob("version=*"))
    assert versions == [3, 4]
    total = usage.read_dashboard(spark, path).agg(F.sum("n")).first()[0]
    opened = usage.read_dashboard(spark, path)
    # a version that is still being written has no marker and is not read
    spark.range(3).select(F.lit("half").alias("event_type"), F.col("id").alias("n")).write.parquet(f"{path}/version=5")
    (tmp_path / "dash" / "version=5" / "_SUCCESS").unlink()
    assert usage.read_dashboard(spark, path).agg(F.sum("n")).first()[0] == total == opened.agg(F.sum("n")).first()[0] == table(spark, SF_SMALL, "events").count()


def test_status_machine_equals_batch(spark, tmp_path):
    states = {"signup": "pending", "view": "virus_scanning", "click": "extracting", "purchase": "chunking", "error": "failed"}
    shape = lambda df: df.select(
        F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("seq"),
        F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[F.col("event_type")].alias("status"))
    events, stream = _event_stream(spark, tmp_path)
    got = _run(stateful.status_changes(shape(stream)), tmp_path)
    bad = {r["seq"] for r in got.filter(~F.col("allowed")).collect()}
    want = {r["seq"] for r in transition_faults(shape(events)).collect()}
    assert got.count() == events.count() and bad == want


def test_status_machine_forgets_settled_documents(spark, tmp_path):
    """Settled documents leave the state, whatever the batches; later changes start anew, earlier ones meet the end."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    whole = ["pending", "virus_scanning", "extracting", "chunking", "embedding", "completed"]
    rows = [(f"d{i}", at(i + 0.1 * j), j, s) for i in range(8) for j, s in enumerate(whole)]
    rows += [("open", at(0), 0, "pending"), ("open", at(60), 1, "virus_scanning"), ("late", at(0), 0, "pending"), ("late", at(1), 1, "failed")]
    rows += [("late", at(2), 2, "pending"), ("late", at(2.5), 3, "failed"), ("late", at(20), 4, "pending"), ("late", at(21), 5, "failed"), ("nothing", None, 0, "pending"), ("nothing", at(1), 1, None)]
    rows += [("clock", at(70), 0, "pending")]
    log = spark.createDataFrame(rows, "doc_id string, ts timestamp, seq int, status string")
    found = []
    for n, bounds in enumerate([(0, 100), (0, 3, 9, 100), (0, 2.2, 2.6, 21, 65, 100)]):
        place = str(tmp_path / str(n))
        for lo, hi in zip(bounds, bounds[1:]):
            when = F.coalesce("ts", F.lit(at(lo)))
            log.where((when >= F.lit(at(lo))) & (when < F.lit(at(hi)))).write.mode("append").parquet(f"{place}/in")
            run = stateful.start_status_machine(spark.readStream.schema(log.schema).parquet(f"{place}/in"), f"{place}/out", f"{place}/cp", keep_hours=12)
            run.awaitTermination(180)
            assert run.exception() is None
        found.append(sorted(tuple(r) for r in spark.read.parquet(f"{place}/out").select("doc_id", "seq", "previous", "status", "allowed").collect()))
        state = spark.read.format("statestore").option("path", f"{place}/cp").option("stateVarName", "last").load()
        assert {r[0] for r in state.select("key.key").collect()} == {"open", "clock"}
    assert found[0] == found[1] == found[2] and len(found[0]) == 8 * 6 + 2 + 6 + 1
    assert [(d, s) for d, s, _, _, ok in found[0] if not ok] == [("late", 2)] and ("late", 4, None, "pending", True) in found[0]


def test_anchored_limits_equal_batch(spark, tmp_path):
    events, stream = _event_stream(spark, tmp_path)
    window, limit = 6 * 3600 * 1000, 2
    got = _run(stateful.anchored_limits(stream, "event_type", "ts", limit, window), tmp_path)
    got = {(r[0], r[1]): r[2] for r in got.groupBy("event_type", "window_start_ms").agg(F.sum("n_refused")).collect()}
    batch = anchored_windows(events, "event_type", "ts", limit, window, window).filter("breach").collect()
    assert got == {(r["event_type"], r["window_start_ms"]): r["n_requests"] - limit for r in batch}


def test_alarm_stream_equals_batch(spark, tmp_path):
    events, stream = _event_stream(spark, tmp_path)
    is_error = F.col("event_type").isin("error", "click")
    got = _run(usage.error_alarms(stream, is_error, period_minutes=240, threshold=1), tmp_path)
    got = {r["alarm_at"] for r in got.collect()}
    want = {r["alarm_at"] for r in error_alarm(events, is_error, period_seconds=240 * 60, threshold=1).collect()}
    newest = events.agg(F.max("ts")).first()[0]
    # windows the watermark has not closed yet are still open in the stream
    closed = {t for t in want if (newest - t).total_seconds() > 3 * 240 * 60}
    assert closed and closed <= got <= want


def test_rate_windows_equal_batch(spark, tmp_path):
    events, stream = _event_stream(spark, tmp_path)
    got = _run(usage.rate_windows(stream, ["event_type"], 2, window="2 hours"), tmp_path)
    got = {(r[0], r[1]): r[2] for r in got.collect()}
    want = {(r[0], r["w"][0]): r["n"] for r in events.groupBy("event_type", F.window("ts", "2 hours").alias("w")).agg(
        F.count("*").alias("n")).filter("n > 2").collect()}
    newest = events.agg(F.max("ts")).first()[0]
    closed = {k: v for k, v in want.items() if (newest - k[1]).total_seconds() > 3 * 3600}
    assert closed and closed.items() <= got.items() <= want.items()


def test_ingest_stream_is_repeatable(spark, tmp_path):
    files = [
        ("a", "kb1", "notes.md", "# One\nfirst line. second.\n## Two\n- item".encode()),
        ("b", "kb1", "data.json", json.dumps({"x": [1, {"y": None}]}).encode()),
        ("c", "kb2", "broken.json", b"{"),
        ("d", "kb2", "old.doc", b"\xd0\xcf"),
        ("e", "kb2", "empty.txt", b""),
        ("f", "kb2", "tool.exe", b"MZ"),
        ("g", "kb2", "blank.txt", b"  \n \n"),
        ("h", "kb2", "fake.pdf", b"PK\x03\x04zip"),
    ]
    rows = [(d, k, "o", n, f"up/{d}", c) for d, k, n, c in files]
    make = lambda part: spark.createDataFrame([(*r[:5], bytearray(r[5])) for r in part], ingest.UPLOADS)
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "store")
    make(rows).coalesce(1).write.parquet(inbox)
    encoder = FeatureHashEncoder(16)
    q = ingest.start_ingest(ingest.upload_stream(spark, inbox), out, str(tmp_path / "cp"), encoder, "hash16")
    q.awaitTermination(180)
    first = {(r["doc_id"], r["chunk_index"]): r["content"] for r in ingest.current_chunks(spark, out).collect()}
    status = {r["doc_id"]: (r["status"], r["status_detail"]) for r in spark.read.parquet(f"{out}/status").collect()}
    assert status["a"] == ("completed", None) and status["b"][0] == "completed"
    assert status["c"][1].startswith("Extraction failed: Could not parse JSON")
    assert status["d"][0] == "failed" and "docx" in status["d"][1]
    assert status["e"] == ("failed", "file is empty") and status["f"][1] == "extension not allowed: exe"
    assert status["g"] == ("failed", "No extractable text content found")
    assert status["h"] == ("failed", "content does not match its extension")
    disposable = {r[0] for r in spark.read.parquet(f"{out}/disposable").select("storage_key").collect()}
    assert disposable == {"up/a", "up/b", "up/e", "up/f", "up/h"}
    assert first[("b", 0)] == "x[0]: 1\nx[1].y: None"

    # the same batch again, and the same document delivered again later
    ingest.process_batch(spark.read.parquet(inbox), 0, out, encoder, "hash16")
    make(rows[:1]).coalesce(1).write.mode("append").parquet(inbox)
    ingest.start_ingest(ingest.upload_stream(spark, inbox), out, str(tmp_path / "cp"), encoder, "hash16").awaitTermination(180)
    again = {(r["doc_id"], r["chunk_index"]): r["content"] for r in ingest.current_chunks(spark, out).collect()}
    assert again == first


def test_failed_documents_are_tried_again_and_given_up(spark, tmp_path):
    out, encoder = str(tmp_path / "store"), FeatureHashEncoder(16)
    broken, good = b"{", b'{"x": 1}'
    send = lambda batch, *rows: ingest.process_batch(spark.createDataFrame(
        [(d, "kb", "o", f"{d}.json", f"up/{d}/{v}", bytearray(c), v, "en", None) for d, v, c in rows], ingest.VERSIONED_UPLOADS), batch, out, encoder, "hash16", max_attempts=2)
    entries = lambda: sorted((r.batch, r.doc_id, r.version, r.outcome, r.attempt) for r in ingest.ledger(spark, out).collect())
    send(0, ("a", 1, broken), ("b", 1, broken), ("c", 1, good), ("c", 1, good), ("d", 5, good))
    first = [(0, "a", 1, "failed", 1), (0, "b", 1, "failed", 1), (0, "c", 1, "completed", 1), (0, "d", 5, "completed", 1)]
    assert entries() == first
    # one comes mended as a newer version, one is tried for the last time, an older version of a stored one comes late
    for _ in range(2):  # a repeated batch changes nothing
        send(1, ("b", 2, good), ("d", 4, broken), ("c", 1, good))
        assert entries() == sorted(first + [(1, "a", 1, "dead", 2), (1, "b", 1, "superseded", 2), (1, "b", 2, "completed", 1), (1, "c", 1, "repeat", 1), (1, "d", 4, "superseded", 1)])
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert {r.doc_id for r in read("dead").collect()} == {"a"} and read("retry").where("batch = 1").count() == 0
    assert {r[0] for r in read("disposable").select("storage_key").collect()} == {"up/c/1", "up/d/5", "up/b/1", "up/b/2", "up/d/4"}
    chunks = ingest.current_chunks(spark, out).collect()
    assert sorted({(r.doc_id, r.batch, r.content, r.language) for r in chunks}) == [("b", 1, "x: 1", "en"), ("c", 0, "x: 1", "en"), ("d", 0, "x: 1", "en")]


def test_stream_dedupe(spark, tmp_path):
    events, stream = _event_stream(spark, tmp_path)
    got = _run(ingest.first_seen(stream.select("event_type", "ts"), ["event_type"], "ts", "100 days"), tmp_path)
    assert got.count() == events.select("event_type").distinct().count()
