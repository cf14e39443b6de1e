"""Ingest of mixed files, and streams replayed over the given tables (everything available, then stop) and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators import counters
from lorewell.operators.encoding import FeatureHashEncoder
from lorewell.plans import query, views
from lorewell.plans.logs import _SQL_STATUS, _status_log, alarm_sql
from lorewell.plans.views import SQL_CHUNKS, SQL_DOCS, SQL_USAGE
from lorewell.session import shared_folder, table
from lorewell.sources import registry
from lorewell.streaming import counters as stored
from lorewell.streaming import ingest, stateful, usage

# What the documents of each last digit deliver: in which batch, as which version, under which ending and content.
_TEXT, _BROKEN, _GOOD, _BLANK = "text", '{"broken": ', '{"fine": true}', " \n "
_DELIVERIES = [
    # first batch: texts, broken and blank files, and types that are not taken
    *((k, 0, 1, "txt", _TEXT) for k in range(5)), (5, 0, 1, "json", _BROKEN), (6, 0, 1, "json", _BROKEN), (7, 0, 1, "exe", _TEXT), (8, 0, 1, "doc", _TEXT), (9, 0, 1, "txt", _BLANK),
    # second: the same twice, a newer one, an older one, two newer ones at once, a mended one
    (0, 1, 1, "txt", _TEXT), (0, 1, 1, "txt", _TEXT), (1, 1, 2, "txt", _TEXT), (2, 1, 0, "txt", _TEXT), (3, 1, 3, "txt", _TEXT), (3, 1, 2, "txt", _TEXT), (5, 1, 2, "json", _GOOD),
    # third: one more repeat
    (4, 2, 1, "txt", _TEXT),
]
_PARSE, _NOTHING = "Extraction failed: Could not parse JSON", "No extractable text content found"
# Digit, batch, version, outcome, reason, attempt of every ledger row that must follow.
_LEDGER = [
    *((k, 0, 1, "completed", None, 1) for k in range(5)), (5, 0, 1, "failed", _PARSE, 1), (6, 0, 1, "failed", _PARSE, 1), (7, 0, 1, "refused", "extension not allowed: exe", 1),
    (8, 0, 1, "dead", "legacy binary word files must be converted to docx first", 1), (9, 0, 1, "failed", _NOTHING, 1),
    (0, 1, 1, "repeat", None, 1), (1, 1, 2, "completed", None, 1), (2, 1, 0, "superseded", None, 1), (3, 1, 3, "completed", None, 1), (3, 1, 2, "superseded", None, 1),
    (5, 1, 2, "completed", None, 1), (5, 1, 1, "superseded", None, 2), (6, 1, 1, "failed", _PARSE, 2), (9, 1, 1, "failed", _NOTHING, 2),
    (4, 2, 1, "repeat", None, 1), (6, 2, 1, "dead", _PARSE, 3), (9, 2, 1, "dead", _NOTHING, 3),
]
_SHOWN = {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 1}  # digit: the batch whose chunks are current
_sql = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


@query(f"""WITH l(digit, batch, version, outcome, reason, attempt) AS (VALUES {", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in _LEDGER)}),
c(digit, current_batch) AS (VALUES {", ".join(map(str, _SHOWN.items()))})
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CAST(l.batch AS INTEGER) AS batch, CAST(l.version AS BIGINT) AS version, l.outcome, l.reason, CAST(l.attempt AS INTEGER) AS attempt,
  l.outcome = 'completed' AS has_chunks, CAST(coalesce(c.current_batch, -1) AS INTEGER) AS current_batch
FROM documents d JOIN l ON d.doc_id % 10 = l.digit LEFT JOIN c ON d.doc_id % 10 = c.digit""")
def ingest_replay(spark, sf_dir):
    """Three batches of deliveries with repeats, versions in and out of order, unreadable and refused files: the ledger of attempts, with the batch whose chunks count."""
    root = shared_folder(spark, "ingest")
    docs = table(spark, sf_dir, "documents")
    for batch in range(3):
        parts = []
        for digit, own, version, ending, content in _DELIVERIES:
            if own == batch:
                body = F.concat(F.lit(f"Version {version}.\n\n"), F.coalesce("text", F.lit(""))) if content == _TEXT else F.lit(content)
                parts.append(F.when(F.col("doc_id") % 10 == digit, F.struct(F.lit(version).cast("long").alias("version"), F.lit(ending).alias("ending"), body.alias("body"))))
        sent = docs.select("doc_id", "source", "lang", F.explode(F.array_compact(F.array(*parts))).alias("d"))
        name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), F.col("d.ending"))
        sent.select(
            F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("kb_id"), F.lit("own").alias("owner_id"), name.alias("name"), F.concat_ws("/", F.lit("up"), F.col("d.version").cast("string"), name).alias("storage_key"),
            F.col("d.body").cast("binary").alias("content"), "d.version", F.col("lang").alias("language"), F.lit(None).cast("timestamp").alias("document_created_at"),
        ).write.mode("append").parquet(f"{root}/inbox")
        uploads = ingest.upload_stream(spark, f"{root}/inbox", schema=ingest.VERSIONED_UPLOADS)
        run = ingest.start_ingest(uploads, f"{root}/store", f"{root}/progress", FeatureHashEncoder(16), "hash16")
        run.awaitTermination()
    current = ingest.current_chunks(spark, f"{root}/store").groupBy("doc_id").agg(F.max("batch").cast("int").alias("current_batch"))
    rows = ingest.ledger(spark, f"{root}/store").join(current, "doc_id", "left")
    return rows.select("doc_id", "batch", "version", "outcome", F.regexp_replace("reason", "(JSON): .*", "$1").alias("reason"), "attempt", (F.col("chunk_count") > 0).alias("has_chunks"), F.coalesce("current_batch", F.lit(-1)).alias("current_batch"))


def _replayed(spark, df, root, files_at_once=None):
    """A table as a stream of the files it is written to."""
    df.write.parquet(f"{root}/in")
    reader = spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(f"{root}/in")


def _requests(spark, sf_dir):
    """The usage log, some of it on paths that are never logged and some without a user."""
    health, nobody = F.col("id") % 11 == 0, F.col("id") % 7 == 0
    logs = views.usage(spark, sf_dir).select("id", F.when(~nobody, F.col("user_id")).alias("user_id"), F.when(health, F.lit("/health")).otherwise(F.col("endpoint")).alias("endpoint"), "status_code")
    return logs.repartitionByRange(3, "id")


@query(f"WITH {SQL_USAGE} SELECT id, user_id, endpoint, status_code FROM logs WHERE id % 11 <> 0 AND id % 7 <> 0")
def usage_append_replay(spark, sf_dir):
    """Requests appended to the log in three batches, and the same files offered once more."""
    root = shared_folder(spark, "usage")
    stream = _replayed(spark, _requests(spark, sf_dir), root, 1)
    for _ in range(2):
        usage.append_usage(stream, f"{root}/log", f"{root}/progress").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/log")


@query(f"""WITH {SQL_USAGE} SELECT endpoint, count(*) AS api_calls, count(*) FILTER (WHERE status_code >= 400) AS api_errors
FROM logs WHERE id % 11 <> 0 AND id % 7 <> 0 GROUP BY endpoint""")
def dashboard_replay(spark, sf_dir):
    """Counts per endpoint kept up to date over three batches; the newest published version."""
    root = shared_folder(spark, "dashboard")
    counts = usage.endpoint_counts(_replayed(spark, _requests(spark, sf_dir), root, 1))
    usage.start_versioned_dashboard(counts, f"{root}/out", f"{root}/progress", refresh=None).awaitTermination()
    return usage.read_dashboard(spark, f"{root}/out")


@query(f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, n AS (SELECT doc_id, count(*) AS chunk_count FROM chunks GROUP BY doc_id),
a AS (SELECT CASE doc_id % 10 WHEN 4 THEN 'moved' ELSE kb_id END AS kb_id, status, size_bytes, CASE WHEN status = 'completed' THEN coalesce(chunk_count, 0) ELSE 0 END AS chunk_count
  FROM docs LEFT JOIN n USING (doc_id) WHERE doc_id % 10 <> 3),
s AS (SELECT kb_id, status, count(*) AS n, sum(size_bytes) AS b, sum(chunk_count) AS c FROM a GROUP BY ALL)
SELECT kb_id, CAST(coalesce(sum(n) FILTER (status = 'completed'), 0) AS BIGINT) AS document_count, CAST(sum(b) AS BIGINT) AS storage_bytes_used, CAST(sum(c) AS BIGINT) AS total_chunk_count,
  string_agg(status || '=' || CAST(n AS VARCHAR), ',' ORDER BY status) AS documents_by_status FROM s GROUP BY kb_id""")
def counters_replay(spark, sf_dir):
    """Counters over the life of all documents, in five batches and two bases: uploads, results of processing, deletes of one in ten, moves of one in ten."""
    root = shared_folder(spark, "counters")
    docs = views.counted_documents(spark, sf_dir)
    image = lambda **change: F.struct(*[change.get(c, F.col(c)).alias(c) for c in docs.columns[1:]]).cast(counters.IMAGE)
    nothing = F.lit(None).cast(counters.IMAGE)
    indexed = F.when(F.col("status") == "completed", F.col("chunk_count")).otherwise(F.lit(0).cast("long"))
    sent, done, moved = image(status=F.lit("pending"), chunk_count=F.lit(0).cast("long")), image(chunk_count=indexed), image(chunk_count=indexed, kb_id=F.lit("moved"))
    digit = F.col("doc_id") % 10
    # when, which documents, before, after
    life = [(F.lit(0) + F.col("doc_id") % 2, F.lit(True), nothing, sent), (F.lit(2), F.col("status") != "pending", sent, done), (F.lit(3), digit == 3, done, nothing), (F.lit(4), digit == 4, done, moved)]
    steps = F.array_compact(F.array(*[F.when(which, F.struct(at.cast("int").alias("step"), before.alias("before"), after.alias("after"))) for at, which, before, after in life]))
    docs.select(F.explode(steps).alias("c")).select("c.*").write.partitionBy("step").parquet(f"{root}/feed")
    for step in range(5):
        spark.read.parquet(f"{root}/feed/step={step}").write.mode("append").parquet(f"{root}/in")
        changes = spark.readStream.schema(f"before {counters.IMAGE}, after {counters.IMAGE}").parquet(f"{root}/in")
        stored.start_counters(changes, f"{root}/out", f"{root}/progress", compact_every=2).awaitTermination()
    out = counters.knowledge_base_counters(stored.read_counters(spark, f"{root}/out"))
    shown = F.array_join(F.transform(F.map_entries("documents_by_status"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.withColumn("documents_by_status", shown)


@query(f"SELECT alarm_at FROM ({alarm_sql(300, 1)})")
def alarm_replay(spark, sf_dir):
    """The alarms of the log as a stream; one event long after the others closes their windows."""
    root = shared_folder(spark, "alarm")
    events = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    closing = events.agg(F.lit("error").alias("event_type"), (F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"))
    stream = _replayed(spark, events.unionByName(closing), root)
    alarms = usage.error_alarms(stream, F.col("event_type") == "error", threshold=1)
    run = alarms.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema(alarms.schema).parquet(f"{root}/out")
    return found.select(F.to_timestamp_ntz(F.date_format("alarm_at", "yyyy-MM-dd HH:mm:ss")).alias("alarm_at"))


@query(f"""WITH {_SQL_STATUS}, p AS (
  SELECT *, lag(status) OVER w AS last, lag(ts) OVER w AS last_ts FROM changes WINDOW w AS (PARTITION BY doc_id ORDER BY ts, seq)),
r AS (SELECT *, CASE WHEN last IN ('completed', 'failed') AND ts - last_ts >= INTERVAL 12 HOUR THEN NULL ELSE last END AS previous FROM p)
SELECT doc_id, seq, coalesce(previous, '') AS previous, status, coalesce(previous, '') || '>' || status IN (
  '>pending', 'pending>virus_scanning', 'virus_scanning>extracting', 'extracting>chunking', 'pending>failed', 'virus_scanning>failed', 'extracting>failed', 'chunking>failed') AS allowed
FROM r""")
def status_machine_replay(spark, sf_dir):
    """The status log in four deliveries, each read by a restarted stream; failed documents are forgotten after twelve hours."""
    root = shared_folder(spark, "status")
    log = _status_log(spark, sf_dir).select("doc_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "status")
    second = F.unix_seconds("ts")
    first, last = log.agg(F.min(second), F.max(second)).first()
    part = F.floor((second - F.lit(first)) * 4 / (F.lit(last) - F.lit(first) + 1))
    for batch in range(4):
        log.where(part == batch).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/in")
        stateful.start_status_machine(stream, f"{root}/out", f"{root}/progress", keep_hours=12).awaitTermination()
    found = spark.read.schema("doc_id long, seq long, previous string, status string, allowed boolean").parquet(f"{root}/out")
    return found.withColumn("previous", F.coalesce("previous", F.lit("")))


def _log_lines(files):
    """A reader of our own: every line of a log is a paragraph of the section its first word names."""
    lines = files.select("doc_id", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("seq", "text"))
    return lines.select("doc_id", F.col("seq").cast("long").alias("seq"), F.lit("paragraph").alias("kind"), "text", F.lit(None).cast("int").alias("heading_level"),
                        F.lit(None).cast("int").alias("page_number"), F.substring_index("text", " ", 1).alias("section_title"))


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS id, doc_id % 8 AS k, lang, source FROM documents)
SELECT doc_id, 'paragraph' AS kind, 'about ' || lang AS text, NULL AS section_title, NULL AS reason FROM d WHERE k = 0
UNION ALL SELECT doc_id, 'paragraph', 'from ' || source, NULL, NULL FROM d WHERE k = 0
UNION ALL SELECT doc_id, 'heading', lang, lang, NULL FROM d WHERE k = 1
UNION ALL SELECT doc_id, 'list_item', source, lang, NULL FROM d WHERE k = 1
UNION ALL SELECT doc_id, 'table', 'id: ' || doc_id || chr(10) || 'at.lang: ' || lang || chr(10) || 'at.tags[0]: a' || chr(10) || 'at.tags[1]: b', NULL, NULL FROM d WHERE k = 2 AND id % 3 > 0
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'Extraction failed: Could not parse JSON' FROM d WHERE k = 2 AND id % 3 = 0
UNION ALL SELECT doc_id, 'table', 'id | lang' || chr(10) || doc_id || ' | ' || lang || ', ' || source, NULL, NULL FROM d WHERE k = 3
UNION ALL SELECT doc_id, 'paragraph', 'lang: ' || lang || chr(10) || 'n: ' || doc_id, NULL, NULL FROM d WHERE k = 4 AND id % 3 > 0
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'Extraction failed: Could not parse XML: tags do not balance' FROM d WHERE k = 4 AND id % 3 = 0
UNION ALL SELECT doc_id, 'paragraph', 'get ' || doc_id, 'get', NULL FROM d WHERE k = 5
UNION ALL SELECT doc_id, 'paragraph', 'put ' || lang, 'put', NULL FROM d WHERE k = 5
UNION ALL SELECT doc_id, NULL, NULL, NULL, CASE k WHEN 6 THEN 'archives are not unpacked' ELSE 'unknown file type' END FROM d WHERE k > 5""")
def routed_blocks(spark, sf_dir):
    """Files of mixed types, stored by type, each read and decoded once by its reader (one of them registered here): blocks and reasons."""
    root = shared_folder(spark, "files")
    ident, bad = F.col("doc_id").cast("string"), F.col("doc_id") % 3 == 0
    lang, source = F.col("lang"), F.col("source")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = [
        ("txt", text("about ", lang, "\n \nfrom ", source)), ("markdown", text("# ", lang, "\n\n- ", source)),
        ("json", F.when(bad, text('{"id": ')).otherwise(text('{"id": ', ident, ', "at": {"lang": "', lang, '", "tags": ["a", "b"]}}'))),
        ("csv", text("id\tlang\n", ident, '\t"', lang, ", ", source, '"\n')),
        ("xml", F.when(bad, text("<r><lang>", lang, "</r></lang>")).otherwise(text("<r><lang>", lang, "</lang><n>", ident, "</n></r>"))),
        ("log", text("get ", ident, "\nput ", lang)), ("zip", text("PK")), (None, text("?")),
    ]
    kind, content = (F.element_at(F.array(*[F.lit(v) if i == 0 else v for v in column]), F.col("doc_id").cast("int") % 8 + 1) for i, column in enumerate(zip(*made)))
    files = table(spark, sf_dir, "documents").select(ident.alias("doc_id"), kind.alias("file_type"), content.cast("binary").alias("content"))
    files.write.partitionBy("file_type").parquet(f"{root}/in")
    registry.register_reader("log", _log_lines)
    try:
        stored = spark.read.schema("doc_id string, content binary, file_type string").parquet(f"{root}/in")
        blocks, failed = registry.read_once(stored, f"{root}/out")
    finally:
        registry.unregister_reader("log")
    reason = F.regexp_replace("reason", "(JSON): .*", "$1")
    nothing = F.lit(None).cast("string")
    return blocks.select("doc_id", "kind", "text", "section_title", nothing.alias("reason")).unionByName(
        failed.select("doc_id", nothing.alias("kind"), nothing.alias("text"), nothing.alias("section_title"), reason.alias("reason")))
