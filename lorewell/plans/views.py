"""The driver tables seen as the tables of the data model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.text import CJK, DEVANAGARI, SENTENCE_END, SPACE_CLASS, SPACES, checksum
from lorewell.operators.chunking import chunk_blocks
from lorewell.operators.encoding import FeatureHashEncoder, encode_column
from lorewell.schemas import CHUNKS
from lorewell.session import shared_folder, spread_small_scan, table
from lorewell.sources.plain import markdown_blocks
from lorewell.sources.tables import write_chunks

DIMENSION = 256
EPOCH = "2024-01-01"
N_SOURCES = 20
N_OWNERS = 4


def _owner(number):
    return F.concat(F.lit("own"), F.pmod(number, F.lit(N_OWNERS)).cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source as knowledge base, label as status, one minute between uploads."""
    number = F.substring("source", 4, 10).cast("int")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("kb_id"), _owner(number).alias("owner_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"),
        F.col("lang").alias("language"), F.col("n_chars").alias("size_bytes"),
        F.timestamp_micros(F.unix_micros(F.lit(EPOCH).cast("timestamp")) + F.col("doc_id") * 60_000_000).alias("created_at"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").otherwise("pending")
    return docs.join(labels, "doc_id", "left").withColumn("status", status).drop("quality")


def knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("kb_id", "owner_id").agg(
        F.count("*").alias("document_count"), F.sum("size_bytes").alias("storage_bytes_used"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations over the knowledge base their number points to."""
    number = F.pmod("conv_id", F.lit(N_SOURCES))
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("session_id"), F.concat(F.lit("src"), number.cast("string")).alias("kb_id"), _owner(number).alias("owner_id"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.concat(F.lit("/"), "event_type").alias("endpoint"),
        F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("ts").alias("created_at"),
    )


def last_event(spark: SparkSession, sf_dir: str):
    """The newest log time, as the fixed ``as_of`` of a report."""
    newest = table(spark, sf_dir, "events").agg(F.max("ts").alias("t")).first()["t"]
    return F.lit(newest)


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as Markdown and chunked, in one pass without a shuffle by document."""
    number = F.substring("source", 4, 10).cast("int")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("kb_id"), _owner(number).alias("owner_id"), "text")
    carry = ("kb_id", "owner_id")
    blocks = markdown_blocks(spread_small_scan(docs, "doc_id"), carry=("doc_id", *carry))
    chunks = chunk_blocks(blocks, carry=carry, clustered=True)
    return chunks.withColumn("chunk_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))).withColumn(
        "checksum", checksum("content"))


def counted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what the counters hold of them; the chunker says how many chunks each has."""
    parts = corpus_chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    docs = documents(spark, sf_dir).select("doc_id", "kb_id", "owner_id", "status", F.col("size_bytes").cast("long").alias("size_bytes"))
    return docs.join(parts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))


def encoded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows as the sink stores them: with vector and the document's name copied in."""
    chunks = corpus_chunks(spark, sf_dir).withColumn(
        "document_name", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")))
    return encode_column(chunks, "content", FeatureHashEncoder(DIMENSION))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table as the sink writes it, read back: documents are chunked and encoded once, however often it is read."""
    path = shared_folder(spark, "chunks")
    chunks = encoded_chunks(spark, sf_dir)
    write_chunks(chunks.select(*[c for c in chunks.columns if c in CHUNKS.names]), path)
    return spark.read.schema(CHUNKS).parquet(path).withColumn("doc_id", F.col("doc_id").cast("long"))


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return encode_column(items, "question", FeatureHashEncoder(DIMENSION), "qvec")


def chat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question to the knowledge base of its session."""
    number = F.pmod("conv_id", F.lit(N_SOURCES))
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("conv_id").alias("session_id"), F.concat(F.lit("src"), number.cast("string")).alias("kb_id"),
        _owner(number).alias("owner_id"), F.col("text").alias("question"),
    )
    return encode_column(turns, "question", FeatureHashEncoder(DIMENSION), "qvec")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given vectors as chunks of the document with the same number; label as knowledge base."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.col("label").alias("kb_id"),
        (F.col("label") % 2).alias("owner_id"), "embedding")
    return vectors


def topic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per label: the mean of its vectors, element by element."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    gathered = F.sort_array(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(
        F.transform(gathered, lambda s: F.round(s["m"], 6).cast("float")).alias("qvec")
    ).select(F.col("label").cast("long").alias("query_id"), F.col("label").alias("kb_id"), (F.col("label") % 2).alias("owner_id"), "qvec")


# ------------------------------------------------------------------ SQL side

SQL_DOCS = f"""docs AS (
  SELECT d.doc_id, d.source AS kb_id, 'own' || CAST(CAST(substr(d.source, 4) AS INTEGER) % {N_OWNERS} AS VARCHAR) AS owner_id,
         'doc-' || CAST(d.doc_id AS VARCHAR) || '.md' AS name, d.lang AS language, d.n_chars AS size_bytes,
         TIMESTAMP '{EPOCH}' + to_minutes(CAST(d.doc_id AS INTEGER)) AS created_at,
         CASE WHEN l.quality = 1 THEN 'completed' WHEN l.quality = 0 THEN 'failed' ELSE 'pending' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

SQL_SESSIONS = f"""sessions AS (
  SELECT DISTINCT conv_id AS session_id, 'src' || CAST(conv_id % {N_SOURCES} AS VARCHAR) AS kb_id,
         'own' || CAST((conv_id % {N_SOURCES}) % {N_OWNERS} AS VARCHAR) AS owner_id FROM conversations)"""

SQL_USAGE = """logs AS (
  SELECT event_id AS id, user_id, '/' || event_type AS endpoint, value AS latency_ms,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, ts AS created_at FROM events)"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_SPACES = sql_text(SPACES)


def sql_trim(text: str) -> str:
    return f"trim({text}, {SQL_SPACES})"


def sql_tokens(text: str) -> str:
    devanagari = f"len(regexp_extract_all({text}, {sql_text(DEVANAGARI)}))"
    cjk = f"len(regexp_extract_all({text}, {sql_text(CJK)}))"
    return (
        f"(CASE WHEN length({text}) = 0 THEN 0 ELSE greatest(1, CAST(trunc((length({text}) - {devanagari} - {cjk}) / 4.0::DOUBLE"
        f" + {devanagari} / 1.5::DOUBLE + {cjk} / 1.5::DOUBLE) AS INTEGER)) END)"
    )


def _sql_latin_tokens(text: str) -> str:
    """Short form inside the folds; the driver texts hold no Devanagari or CJK."""
    return f"(CASE WHEN length({text}) = 0 THEN 0 ELSE greatest(1, length({text}) // 4) END)"


def sql_sentences(text: str) -> str:
    """DuckDB has no look-behind: mark the gap after the stop, then split at the mark."""
    stop = SENTENCE_END.removeprefix("(?<=").removesuffix(")")
    return f"string_split(regexp_replace({text}, {sql_text(f'({stop}){SPACE_CLASS}+')}, '\\1' || chr(1), 'g'), chr(1))"


def _sql_tail(text: str, limit: int = 64) -> str:
    longer = "(y.a || ' ' || x.a)"
    return (
        f"(list_reduce(list_transform(list_reverse({sql_sentences(text)}), lambda s: {{'a': s, 'stop': false}}), lambda x, y: "
        f"CASE WHEN x.stop THEN x WHEN {_sql_latin_tokens(longer)} > {limit} THEN {{'a': x.a, 'stop': true}} "
        f"ELSE {{'a': y.a || ' ' || x.a, 'stop': false}} END)).a"
    )


def _sql_pack(text: str, limit: int = 512) -> str:
    longer = "(u.cur || ' ' || v.cur)"
    return (
        f"list_reduce(list_transform({sql_sentences(text)}, lambda s: {{'cur': s, 'done': CAST([] AS VARCHAR[])}}), lambda u, v: "
        f"CASE WHEN {_sql_latin_tokens(longer)} > {limit} THEN {{'cur': v.cur, 'done': list_append(u.done, u.cur)}} "
        f"ELSE {{'cur': u.cur || ' ' || v.cur, 'done': u.done}} END)"
    )


def _state(sec: str, parts: str, run: str, out: str) -> str:
    return f"{{'txt': '', 'tk': 0, 'sec': {sec}, 'pieces': CAST([] AS VARCHAR[]), 'parts': {parts}, 'run': {run}, 'out': {out}}}"


def sql_chunk_fold(source: str, keys: str, out: str) -> str:
    """The chunker as one SQL fold per document, written independently of the Python one.

    ``source(keys, i, kind, txt, sec)`` are blocks; a heading is preceded by an
    element that only flushes. Emitted texts carry their section in front.
    """
    glue, cut = "chr(10) || chr(10)", "chr(2)"
    sec = "coalesce(e.sec, s.sec)"
    emitted = lambda label: f"{label} || {cut} || s.parts"
    flushed = lambda label: f"CASE WHEN s.parts = '' THEN s.out ELSE list_append(s.out, {emitted(label)}) END"
    tail = f"CASE WHEN s.parts = '' THEN '' ELSE {_sql_tail('s.parts')} END"
    tail_tokens = f"CASE WHEN s.parts = '' THEN 0 ELSE {_sql_latin_tokens(_sql_tail('s.parts'))} END"
    heading = _state("s.sec", tail, tail_tokens, flushed("s.sec"))
    long = _state(sec, tail, tail_tokens, f"list_concat({flushed(sec)}, list_transform(e.pieces, lambda p: {sec} || {cut} || p))")
    full = _state(sec, f"{_sql_tail('s.parts')} || {glue} || e.txt", f"{_sql_latin_tokens(_sql_tail('s.parts'))} + e.tk", f"list_append(s.out, {emitted(sec)})")
    add = _state(sec, f"CASE WHEN s.parts = '' THEN e.txt ELSE s.parts || {glue} || e.txt END", "s.run + e.tk", "s.out")
    return f"""{out}_tokens AS (SELECT *, {_sql_latin_tokens('txt')} AS tk FROM {source}),
{out}_elements AS (
  SELECT {keys}, i * 2 AS i, txt, tk, sec, CASE WHEN tk > 512 THEN list_append(r.done, r.cur) ELSE CAST([] AS VARCHAR[]) END AS pieces
  FROM (SELECT *, {_sql_pack('txt')} AS r FROM {out}_tokens)
  UNION ALL SELECT {keys}, i * 2 - 1, '', -1, NULL, CAST([] AS VARCHAR[]) FROM {out}_tokens WHERE kind = 'heading'),
{out}_docs AS (
  SELECT {keys}, list({{'txt': txt, 'tk': tk, 'sec': sec, 'pieces': pieces, 'parts': '', 'run': 0, 'out': CAST([] AS VARCHAR[])}} ORDER BY i) AS l
  FROM {out}_elements GROUP BY ALL),
{out}_folded AS (
  SELECT {keys}, list_reduce(l, lambda s, e:
    CASE WHEN e.tk = -1 THEN {heading} WHEN e.tk > 512 THEN {long} WHEN s.parts <> '' AND s.run + e.tk > 512 THEN {full} ELSE {add} END,
    {_state("''", "''", "0", "CAST([] AS VARCHAR[])")}) AS r FROM {out}_docs),
{out}_lists AS (
  SELECT {keys}, CASE WHEN r.parts = '' THEN r.out ELSE list_append(r.out, r.sec || {cut} || r.parts) END AS cs FROM {out}_folded),
{out}_rows AS (SELECT {keys}, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS chunk_index, unnest(cs) AS c FROM {out}_lists),
{out} AS (SELECT *, CAST({_sql_latin_tokens('content')} AS INTEGER) AS token_count FROM (
  SELECT {keys}, chunk_index, split_part(c, {cut}, 1) AS section, split_part(c, {cut}, 2) AS content FROM {out}_rows))"""


SQL_CHUNKS = f"""lines AS (
  SELECT doc_id, kb_id, owner_id, i, 'paragraph' AS kind, txt, NULL::VARCHAR AS sec FROM (
    SELECT doc_id, kb_id, owner_id, generate_subscripts(l, 1) AS i, {sql_trim('unnest(l)')} AS txt
    FROM (SELECT doc_id, source AS kb_id, 'own' || CAST(CAST(substr(source, 4) AS INTEGER) % {N_OWNERS} AS VARCHAR) AS owner_id,
                 string_split(text, chr(10)) AS l FROM documents)) WHERE txt <> ''),
{sql_chunk_fold('lines', 'doc_id, kb_id, owner_id', 'packed')},
chunks AS (SELECT *, CAST(doc_id AS VARCHAR) || '/' || CAST(chunk_index AS VARCHAR) AS chunk_id FROM packed)"""

SQL_CHAT_QUESTIONS = f"""questions AS (
  SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS query_id, conv_id AS session_id,
         'src' || CAST(conv_id % {N_SOURCES} AS VARCHAR) AS kb_id,
         'own' || CAST((conv_id % {N_SOURCES}) % {N_OWNERS} AS VARCHAR) AS owner_id, text AS question
  FROM conversations WHERE role = 'user')"""


def sql_encode(source: str, ident: str, text: str, keys: str, out: str) -> str:
    """Feature-hash vectors as sparse unit rows ``(keys, ident, bucket, w)``."""
    sep = f"{keys}, " if keys else ""
    return f"""{out}_words AS (
  SELECT {sep}{ident}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {source}),
{out}_hashed AS (SELECT {sep}{ident}, md5(word) AS h FROM {out}_words),
{out}_counts AS (
  SELECT {sep}{ident}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {DIMENSION} AS bucket,
         sum(CASE WHEN CAST('0x' || substr(h, 9, 1) AS BIGINT) < 8 THEN 1 ELSE -1 END)::DOUBLE AS c
  FROM {out}_hashed GROUP BY ALL),
{out}_floats AS (
  SELECT {sep}{ident}, bucket, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {ident})) AS FLOAT) AS DOUBLE) AS f
  FROM {out}_counts WHERE c <> 0),
{out} AS (SELECT {sep}{ident}, bucket, f / sqrt(sum(f * f) OVER (PARTITION BY {ident})) AS w FROM {out}_floats)"""


SQL_TOPIC_QUESTIONS = """topics AS (
  SELECT CAST(label AS BIGINT) AS query_id, label AS kb_id, label % 2 AS owner_id, list(m ORDER BY i)::FLOAT[] AS qvec FROM (
    SELECT label, i, CAST(round(avg(CAST(x AS DOUBLE)), 6) AS FLOAT) AS m
    FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i)
  GROUP BY label)"""
SQL_COSINE = "round(list_dot_product(q.qvec::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.qvec::DOUBLE[], q.qvec::DOUBLE[])) / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 12)"
