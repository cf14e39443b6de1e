"""Incremental ingest: new files in, chunk rows, statuses and a ledger of attempts out, safe to repeat.

Deliveries may come twice, late or out of order, and may hold what cannot be read. Every delivery of
a document gets a row in the ledger: ``completed``, ``refused`` (gate), ``failed`` (to be tried
again), ``dead`` (tried often enough, or of no use to try), ``repeat`` (this version is stored) or
``superseded`` (a newer one is known). A failed document is queued for the next batch with
its content and leaves its neighbours alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lorewell.functions import rules
from lorewell.functions.text import checksum
from lorewell.operators.chunking import CHUNK_SIZE_TOKENS, OVERLAP_TOKENS, chunk_blocks, chunk_id
from lorewell.operators.encoding import Encoder, encode_column
from lorewell.operators.ingest import finalise
from lorewell.schemas import TABLES
from lorewell.session import fits_broadcast
from lorewell.sources.registry import outcomes
from lorewell.sources.tables import write_chunks

UPLOADS = "doc_id string, kb_id string, owner_id string, name string, storage_key string, content binary"
# Optional columns: without a version the later batch is the newer one.
VERSIONED_UPLOADS = UPLOADS + ", version long, language string, document_created_at timestamp"
MAX_ATTEMPTS = 3
LEDGER = "doc_id string, version long, storage_key string, outcome string, reason string, attempt int, chunk_count long, batch int"
_KEY = ["doc_id", "version", "storage_key"]
_READ = ["doc_id", "seq", "kind", "text", "heading_level", "page_number", "section_title"]


def upload_stream(spark: SparkSession, path: str, max_files: int = 1000, schema: str = UPLOADS) -> DataFrame:
    """Arriving upload records (Parquet files dropped in a folder), bounded per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ledger(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """One row per delivery that was looked at, of all batches or of those before one."""
    rows = _table(spark, f"{out}/ledger", LEDGER)
    return rows if before is None else rows.filter(F.col("batch") < before)


def _table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def _store(df: DataFrame, out: str, name: str, batch: int) -> DataFrame:
    """Write to the batch's own folder, which a repeated attempt overwrites, and read back."""
    path = f"{out}/{name}/batch={batch}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast rows of a few strings when they are measured to be few; a shuffle otherwise."""
    strings = [F.octet_length(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    size = sum((F.coalesce(s, F.lit(0)) for s in strings), F.lit(64))
    return F.broadcast(df) if fits_broadcast(df, size) else df


def _deliveries(uploads: DataFrame, out: str, batch: int) -> DataFrame:
    """The batch's uploads and the failed ones of the batch before."""
    spark = uploads.sparkSession
    arrived = uploads
    for name, value in (("version", F.lit(batch).cast("long")), ("language", F.lit(None).cast("string")), ("document_created_at", F.lit(None).cast("timestamp"))):
        if name not in uploads.columns:
            arrived = arrived.withColumn(name, value)
    return arrived.unionByName(_table(spark, f"{out}/retry", VERSIONED_UPLOADS + ", batch int").filter(F.col("batch") == batch - 1).drop("batch"))


def _judge(rows: DataFrame, out: str, batch: int, max_attempts: int) -> DataFrame:
    """What to do with each delivery (a row per version and storage key): content is not looked at beyond its head."""
    spark = rows.sparkSession
    size, head = F.octet_length("content").cast("long"), F.substring("content", 1, 12)
    faces = rows.select(*_KEY, "kb_id", "owner_id", "name", "language", "document_created_at", size.alias("size_bytes"), head.alias("head"))
    held = faces.groupBy(*_KEY).agg(F.count("*").alias("copies"), *(F.max(c).alias(c) for c in faces.columns if c not in _KEY))
    order = F.struct("version", "storage_key")
    newest = held.groupBy("doc_id").agg(F.max(order).alias("newest"))
    past = ledger(spark, out, before=batch).join(_small(newest.select("doc_id")), "doc_id", "left_semi")
    stored = past.groupBy("doc_id").agg(F.max(F.when(F.col("outcome") == "completed", F.col("version"))).alias("stored_version"))
    tries = past.filter(F.col("outcome") == "failed").groupBy("doc_id", "version").agg(F.max("attempt").alias("tries"))
    file_type = rules.file_type("name")
    refused = F.coalesce(rules.upload_rejection("name", "size_bytes"), F.when(rules.signature_mismatch("file_type", "head"), "content does not match its extension"))
    known = held.join(newest, "doc_id").join(stored, "doc_id", "left").join(tries, ["doc_id", "version"], "left").withColumn("file_type", file_type)
    outcome: Column = (
        F.when((F.col("version") < F.col("stored_version")) | (order < F.col("newest")), "superseded")
        .when(F.col("version") == F.col("stored_version"), "repeat").when(refused.isNotNull(), "refused"))
    attempt = F.coalesce("tries", F.lit(0)) + 1
    return known.select(*faces.columns, "file_type", "copies", refused.alias("reject_reason"), outcome.alias("outcome"), attempt.cast("int").alias("attempt"), (attempt >= max_attempts).alias("last_attempt"))


def _contents(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Content of the accepted deliveries, once each; only those that came several times are shuffled."""
    once, often = (_small(accepted.filter(c).select(*_KEY, "file_type")) for c in ("copies = 1", "copies > 1"))
    return rows.join(once, _KEY).unionByName(rows.join(often, _KEY).dropDuplicates(_KEY))


def process_batch(
    uploads: DataFrame, batch_id: int, out: str, encoder: Encoder, model: str,
    size: int = CHUNK_SIZE_TOKENS, overlap: int = OVERLAP_TOKENS, max_attempts: int = MAX_ATTEMPTS,
) -> None:
    """One micro-batch: judge, read once, chunk, encode, store, then status, ledger, queue and disposable originals.

    Everything is written to folders named by the batch and overwritten when the batch is
    repeated, earlier batches are only read, and ids follow from the content's place, so delivery
    may be at-least-once. Of several versions of a document the newest counts. Originals
    are only reported as disposable after chunks and ledger are stored: those of completed, refused,
    repeated and superseded deliveries; a failed or dead one keeps its original.
    """
    spark = uploads.sparkSession
    rows = _deliveries(uploads, out, batch_id)
    judged = _store(_judge(rows, out, batch_id, max_attempts), out, "judged", batch_id)
    accepted = judged.filter(F.col("outcome").isNull())
    read = _store(outcomes(_contents(rows, accepted).select("doc_id", "file_type", "content")), out, "read", batch_id)
    failures = read.filter(F.col("error").isNotNull()).select("doc_id", F.col("error").alias("reason"), "fatal")
    tenant = _small(accepted.select("doc_id", "kb_id", "owner_id", F.col("name").alias("document_name"), "language", "document_created_at"))
    chunks = encode_column(chunk_blocks(read.filter(F.col("error").isNull()).select(*_READ), size, overlap), "content", encoder)
    whole = chunks.join(tenant, "doc_id").join(failures.select("doc_id"), "doc_id", "left_anti")
    write_chunks(whole.withColumns({
        "chunk_id": chunk_id(), "checksum": checksum("content"), "embedding_model": F.lit(model), "created_at": F.current_timestamp()}), f"{out}/chunks", batch_id)

    # a batch without chunks leaves a folder without files, so the schema is given
    stored = spark.read.schema(TABLES["document_chunks"]).parquet(f"{out}/chunks/batch={batch_id}").select("doc_id", "token_count")
    tried = judged.filter(F.col("outcome").isNull() | (F.col("outcome") == "refused"))
    refused = tried.filter(F.col("outcome") == "refused").select("doc_id", F.col("reject_reason").alias("reason"))
    final = finalise(tried.drop("size_bytes", "head", "copies"), stored, failures.select("doc_id", "reason").unionByName(refused))
    status = _store(final, out, "status", batch_id)

    fatal = failures.groupBy("doc_id").agg(F.max("fatal").alias("fatal"))
    ended = status.join(fatal, "doc_id", "left").select(
        *_KEY, F.coalesce("outcome", F.when(F.col("status") == "completed", "completed").when(F.coalesce("fatal", F.lit(False)) | F.col("last_attempt"), "dead").otherwise("failed")).alias("outcome"),
        F.col("status_detail").alias("reason"), "attempt", "chunk_count")
    passed = judged.filter(F.col("outcome").isin("repeat", "superseded")).select(*_KEY, "outcome", F.lit(None).cast("string").alias("reason"), "attempt", F.lit(0).cast("long").alias("chunk_count"))
    entries = _store(ended.unionByName(passed), out, "ledger", batch_id)

    again = entries.filter(F.col("outcome") == "failed").select(*_KEY, F.lit("").alias("file_type"), F.lit(1).alias("copies"))
    queue = rows.join(_small(again.select(*_KEY)), _KEY, "left_semi").dropDuplicates(_KEY)
    _store(queue.select(*[n.split()[0] for n in VERSIONED_UPLOADS.split(", ")]), out, "retry", batch_id)
    _store(entries.filter(F.col("outcome") == "dead"), out, "dead", batch_id)
    done = F.col("outcome").isin("completed", "refused", "repeat", "superseded")
    _store(entries.filter(done).select("storage_key"), out, "disposable", batch_id)


def start_ingest(uploads: DataFrame, out: str, checkpoint: str, encoder: Encoder, model: str, **options) -> StreamingQuery:
    """Run over everything that has arrived, then stop; restart to go on from the checkpoint."""
    return (
        uploads.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, batch: process_batch(df, batch, out, encoder, model, **options)).start()
    )


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Stored chunks of the newest completed version of each document, by the ledger alone."""
    rows = _table(spark, f"{out}/chunks", T.StructType([*TABLES["document_chunks"].fields, T.StructField("batch", T.IntegerType())]))
    order = F.struct("version", "batch")
    newest = ledger(spark, out).filter(F.col("outcome") == "completed").groupBy("doc_id").agg(F.max_by("batch", order).alias("batch"))
    return rows.join(newest, ["doc_id", "batch"], "left_semi")


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeated content (for example by ``kb_id`` and ``checksum``) arriving within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
