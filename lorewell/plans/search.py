"""Vector search, retrieval, context, prompts, citations and chat history."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions import display, vectors
from lorewell.functions.text import content_key
from lorewell.operators import context, retrieval, similarity
from lorewell.plans import query, views
from lorewell.plans.views import (
    DIMENSION, SQL_CHAT_QUESTIONS, SQL_CHUNKS, SQL_COSINE, SQL_DOCS, SQL_TOPIC_QUESTIONS, sql_encode, sql_tokens, sql_trim,
)
from lorewell.session import table

VECTOR_DIMENSION = 64
TOPIC_FLOOR = 0.1
CHAT_FLOOR = 0.4
TABLES, BITS = 6, 3


# ------------------------------------------------------------- given vectors

def _topic_hits_sql(k: int = 8, floor: float = TOPIC_FLOOR) -> str:
    return f"""{SQL_TOPIC_QUESTIONS},
scored AS (SELECT q.query_id, c.vec_id AS chunk_id, {SQL_COSINE} AS similarity
  FROM topics q JOIN embeddings c ON c.label = q.kb_id AND c.label % 2 = q.owner_id),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
  FROM scored WHERE similarity >= {floor} QUALIFY rank <= {k})"""


def _topic_hits(spark, sf_dir, k: int = 8, floor: float = TOPIC_FLOOR, **options):
    return similarity.top_k_join(
        views.topic_questions(spark, sf_dir), views.vector_chunks(spark, sf_dir), retrieval.TENANT, k, floor, **options)


@query(f"WITH {_topic_hits_sql()} SELECT query_id, rank, chunk_id, round(similarity, 6) AS similarity FROM hits")
def knn_topk(spark, sf_dir):
    """Nearest vectors to the mean vector of each label, within the label."""
    return _topic_hits(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_topic_hits_sql()} SELECT query_id, rank, chunk_id, round(similarity, 6) AS similarity FROM hits")
def knn_topk_salted(spark, sf_dir):
    """The same through the shuffled route taken when the questions are too large to broadcast."""
    return _topic_hits(spark, sf_dir, broadcast_limit=-1).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {SQL_TOPIC_QUESTIONS}, {SQL_DOCS},
scored AS (SELECT q.query_id, c.vec_id AS chunk_id, {SQL_COSINE} AS similarity
  FROM topics q JOIN embeddings c ON c.label = q.kb_id AND c.label % 2 = q.owner_id JOIN docs d ON d.doc_id = c.vec_id
  WHERE CASE q.query_id % 4 WHEN 0 THEN d.language = 'en'
    WHEN 1 THEN d.created_at >= TIMESTAMP '2024-01-01 01:00:00' AND d.created_at <= TIMESTAMP '2024-01-01 05:00:00'
    WHEN 2 THEN d.doc_id BETWEEN q.query_id AND q.query_id + 150 ELSE true END)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank, chunk_id,
  round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.05 QUALIFY rank <= 5""")
def knn_topk_filtered(spark, sf_dir):
    """Each question with its own filter: language, upload dates, documents, none."""
    pick = F.col("query_id") % 4
    asked = views.topic_questions(spark, sf_dir).withColumns({
        "language": F.when(pick == 0, "en"),
        "uploaded_after": F.when(pick == 1, F.lit("2024-01-01 01:00:00").cast("timestamp")),
        "uploaded_before": F.when(pick == 1, F.lit("2024-01-01 05:00:00").cast("timestamp")),
        "doc_ids": F.when(pick == 2, F.sequence("query_id", F.col("query_id") + 150)).otherwise(F.array().cast("array<bigint>")),
    })
    docs = views.documents(spark, sf_dir).select("doc_id", "language", "created_at")
    chunks = views.vector_chunks(spark, sf_dir).join(docs, "doc_id")
    return similarity.top_k_join(asked, chunks, retrieval.TENANT, 5, 0.05, filtered=True).withColumn(
        "similarity", F.round("similarity", 6))


@query(f"""WITH {_topic_hits_sql()} SELECT query_id, chunk_id, round(similarity, 6) AS similarity,
  CAST(round(round(similarity, 6) * 10) AS INTEGER) AS dots, CAST(round(round(similarity, 6) * 100) AS INTEGER) AS percent, round(round(similarity, 6), 4) AS shown FROM hits""")
def cosine_rescored(spark, sf_dir):
    """Kept hits scored again by the vector expression, with the values shown beside them."""
    hits = _topic_hits(spark, sf_dir).select("query_id", "chunk_id")
    pairs = hits.join(views.topic_questions(spark, sf_dir).select("query_id", "qvec"), "query_id").join(
        views.vector_chunks(spark, sf_dir).select("chunk_id", "embedding"), "chunk_id")
    score = F.round(vectors.cosine_similarity("qvec", "embedding"), 6)
    return pairs.select("query_id", "chunk_id", score.alias("similarity")).withColumns({
        "dots": display.match_dots("similarity"), "percent": display.match_percent("similarity"),
        "shown": display.shown_similarity("similarity")})


@query(f"""WITH {_topic_hits_sql(floor=0.72)}, n AS (SELECT query_id, count(*) AS n_hits, max(similarity) AS best FROM hits GROUP BY query_id)
SELECT t.query_id, coalesce(n.n_hits, 0) AS n_hits, CASE WHEN n.n_hits IS NULL THEN 'no_answer' ELSE 'answered' END AS outcome,
  round(coalesce(n.best, 0.0), 6) AS confidence FROM topics t LEFT JOIN n USING (query_id)""")
def retrieval_no_answer(spark, sf_dir):
    asked = views.topic_questions(spark, sf_dir)
    hits = _topic_hits(spark, sf_dir, floor=retrieval.MIN_SIMILARITY)
    return retrieval.outcomes(asked, hits).withColumn("confidence", F.round("confidence", 6))


@query("""SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'dimension 32' WHEN 1 THEN 'zero norm' WHEN 2 THEN 'missing' END AS fault FROM embeddings""")
def dimension_check(spark, sf_dir):
    """Vectors cut short, zeroed or dropped by their number, next to sound ones."""
    pick = F.col("vec_id") % 5
    stored = (
        F.when(pick == 0, F.slice("embedding", 1, 32))
        .when(pick == 1, F.transform("embedding", lambda x: (x * 0).cast("float")))
        .when(pick == 2, F.lit(None)).otherwise(F.col("embedding"))
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.dimension_fault(stored, VECTOR_DIMENSION).alias("fault"))


_SQL_APPROXIMATE = f"""{_topic_hits_sql()},
planes AS (SELECT t, b, e, CASE WHEN (((t * 7919 + b * 104729 + e * 1299709 + 15485863) * 2654435761 % 4294967296) >> 16) % 2 = 1 THEN 1 ELSE -1 END AS s
  FROM range({TABLES}) a(t), range({BITS}) c(b), range({VECTOR_DIMENSION}) d(e)),
elements AS (SELECT 'c' AS side, vec_id AS id, label AS kb_id, generate_subscripts(embedding, 1) - 1 AS e, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
  UNION ALL SELECT 'q', query_id, kb_id, generate_subscripts(qvec, 1) - 1, CAST(unnest(qvec) AS DOUBLE) FROM topics),
bits AS (SELECT side, id, kb_id, t, b, sum(x * s) > 0 AS on_side FROM elements JOIN planes USING (e) GROUP BY ALL),
buckets AS (SELECT side, id, kb_id, t, sum(CASE WHEN on_side THEN 1 << b ELSE 0 END) AS bucket FROM bits GROUP BY ALL),
candidates AS (SELECT DISTINCT q.id AS query_id, c.id AS chunk_id FROM buckets q JOIN buckets c USING (kb_id, t, bucket) WHERE q.side = 'q' AND c.side = 'c'),
near AS (SELECT s.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
  FROM scored s JOIN candidates USING (query_id, chunk_id) WHERE similarity >= {TOPIC_FLOOR} QUALIFY rank <= 8)"""


def _approximate(spark, sf_dir):
    return similarity.approximate_top_k(
        views.topic_questions(spark, sf_dir), views.vector_chunks(spark, sf_dir), retrieval.TENANT,
        similarity.Planes(VECTOR_DIMENSION, TABLES, BITS), 8, TOPIC_FLOOR)


@query(f"WITH {_SQL_APPROXIMATE} SELECT query_id, rank, chunk_id, round(similarity, 6) AS similarity FROM near")
def ann_topk(spark, sf_dir):
    return _approximate(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_SQL_APPROXIMATE} SELECT h.query_id, count(*) AS n_exact, count(n.chunk_id) AS n_found, round(count(n.chunk_id) / count(*), 6) AS recall
FROM hits h LEFT JOIN near n USING (query_id, chunk_id) GROUP BY h.query_id""")
def ann_recall(spark, sf_dir):
    return similarity.recall_at_k(_topic_hits(spark, sf_dir), _approximate(spark, sf_dir))


# ------------------------------------------------------------- encoded texts

_SQL_BENCH = f"""{SQL_CHUNKS}, items AS (SELECT item_id AS query_id, text AS question FROM benchmark),
{sql_encode('items', 'query_id', 'question', '', 'qv')},
{sql_encode('chunks', 'chunk_id', 'content', '', 'cv')},
scored AS (SELECT q.query_id, c.chunk_id, round(sum(q.w * c.w), 12) AS similarity FROM qv q JOIN cv c USING (bucket) GROUP BY ALL),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
  FROM scored WHERE similarity >= {CHAT_FLOOR} QUALIFY rank <= 8)"""


@query(f"WITH {_SQL_BENCH} SELECT query_id, rank, chunk_id, round(similarity, 6) AS similarity FROM hits")
def hash_embed_search(spark, sf_dir):
    """Every benchmark text against the whole corpus as a single tenant."""
    asked = views.benchmark_questions(spark, sf_dir).withColumn("kb_id", F.lit("all"))
    chunks = views.encoded_chunks(spark, sf_dir).withColumn("kb_id", F.lit("all"))
    return similarity.top_k_join(asked, chunks, ["kb_id"], 8, CHAT_FLOOR, dimension=DIMENSION).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {SQL_CHUNKS}, {sql_encode('chunks', 'chunk_id', 'content', '', 'cv')}
SELECT c.chunk_id, count(f) AS n_buckets, round(least(coalesce(min(f), 0.0), 0.0), 6) + 0.0 AS smallest, round(greatest(coalesce(max(f), 0.0), 0.0), 6) AS largest
FROM chunks c LEFT JOIN cv_floats v ON v.chunk_id = c.chunk_id GROUP BY c.chunk_id""")
def encode_chunks(spark, sf_dir):
    """Filled buckets and extremes of every chunk vector."""
    e = F.col("embedding")
    rounded = lambda c: F.round(c.cast("double"), 6) + 0.0
    return views.encoded_chunks(spark, sf_dir).select(
        "chunk_id", F.size(F.array_remove(e, F.lit(0.0).cast("float"))).cast("long").alias("n_buckets"),
        rounded(F.array_min(e)).alias("smallest"), rounded(F.array_max(e)).alias("largest"),
    )


_SQL_CHAT = f"""{SQL_CHUNKS}, {SQL_CHAT_QUESTIONS},
{sql_encode('questions', 'query_id', 'question', 'kb_id, owner_id', 'qv')},
{sql_encode('chunks', 'chunk_id', 'content', 'kb_id, owner_id', 'cv')},
scored AS (SELECT q.query_id, c.chunk_id, round(sum(q.w * c.w), 12) AS similarity FROM qv q JOIN cv c USING (kb_id, owner_id, bucket) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
  FROM scored WHERE similarity >= {CHAT_FLOOR} QUALIFY rank <= 8),
hits AS (SELECT r.*, c.doc_id, 'doc-' || CAST(c.doc_id AS VARCHAR) || '.md' AS document_name, c.content FROM ranked r JOIN chunks c USING (chunk_id)),
fresh AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, lower({sql_trim('content')}) ORDER BY rank) = 1),
running AS (SELECT *, {sql_tokens('content')} AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n,
  CAST(sum({sql_tokens('content')}) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS running_tokens FROM fresh),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS source_no
  FROM running WHERE running_tokens <= 3000 OR n = 1)"""


def chat_hits(spark, sf_dir):
    asked = views.chat_questions(spark, sf_dir)
    return asked, retrieval.retrieve(
        asked, views.stored_chunks(spark, sf_dir), views.documents(spark, sf_dir), min_similarity=CHAT_FLOOR,
        dimension=DIMENSION)


@query(f"WITH {_SQL_CHAT} SELECT query_id, rank, chunk_id, doc_id, document_name, content, round(similarity, 6) AS similarity FROM hits")
def chat_retrieval(spark, sf_dir):
    """Every user turn against the knowledge base of its session."""
    _, hits = chat_hits(spark, sf_dir)
    return hits.select("query_id", "rank", "chunk_id", "doc_id", "document_name", "content", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_SQL_CHAT} SELECT query_id, rank, chunk_id, document_name, content, round(similarity, 6) AS similarity FROM hits")
def stored_chunk_search(spark, sf_dir):
    """The same over chunk rows written by the sink once and read back, as a service keeps them."""
    _, hits = chat_hits(spark, sf_dir)
    return hits.select("query_id", "rank", "chunk_id", "document_name", "content", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_SQL_CHAT} SELECT query_id, rank, chunk_id, lower({sql_trim('content')}) AS content_key FROM fresh")
def context_dedupe(spark, sf_dir):
    _, hits = chat_hits(spark, sf_dir)
    return context.drop_repeats(hits).select("query_id", "rank", "chunk_id", content_key("content").alias("content_key"))


@query(f"WITH {_SQL_CHAT} SELECT query_id, source_no, rank, chunk_id, tokens, running_tokens FROM kept")
def context_budget(spark, sf_dir):
    _, hits = chat_hits(spark, sf_dir)
    return context.build_context(hits).select("query_id", "source_no", "rank", "chunk_id", "tokens", "running_tokens")


_SQL_SOURCES = """sources AS (SELECT query_id, count(*) AS n_sources, max(similarity) AS best,
  string_agg('[' || CAST(source_no AS VARCHAR) || '] (' || document_name || '):' || chr(10) || content, chr(10) || chr(10) ORDER BY source_no) AS listing
  FROM kept GROUP BY query_id)"""


_SQL_HISTORY = """earlier AS (SELECT a.conv_id AS session_id, CAST(a.conv_id AS VARCHAR) || '/' || CAST(a.turn AS VARCHAR) AS query_id, b.turn, b.role, b.text
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn AND a.role = 'user'
  QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) <= 10),
spoken AS (SELECT query_id, count(*) AS n_history, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS said FROM earlier WHERE role <> 'system' GROUP BY query_id)"""


@query(f"""WITH {_SQL_CHAT}, {_SQL_SOURCES}
SELECT q.query_id, CASE WHEN s.query_id IS NULL THEN 'no_answer' ELSE 'answered' END AS outcome, round(coalesce(s.best, 0.0), 6) AS confidence,
  coalesce(s.n_sources, 0) AS n_sources, '<question>' || q.question || '</question>' || chr(10) || '<passages>' || chr(10) || s.listing || chr(10) || '</passages>' AS prompt,
  CASE WHEN s.query_id IS NULL THEN 0 ELSE 2 END AS n_messages
FROM questions q LEFT JOIN sources s USING (query_id)""")
def context_prompt(spark, sf_dir):
    """The flagship: questions to prompts, confidence and the no-answer set, in one job."""
    asked, hits = chat_hits(spark, sf_dir)
    return context.prompts(asked, context.build_context(hits)).select(
        "query_id", "outcome", F.round("confidence", 6).alias("confidence"), "n_sources", "prompt",
        F.coalesce(F.size("messages"), F.lit(0)).alias("n_messages"))


@query(f"""WITH {_SQL_CHAT}, {_SQL_SOURCES}, {_SQL_HISTORY}
SELECT q.query_id, q.session_id, CASE WHEN s.query_id IS NULL THEN 0 ELSE 2 + coalesce(h.n_history, 0) END AS n_messages,
  CASE WHEN s.query_id IS NULL THEN '' ELSE coalesce(h.said, '') END AS said
FROM questions q LEFT JOIN sources s USING (query_id) LEFT JOIN spoken h USING (query_id)""")
def prompts_with_history(spark, sf_dir):
    """Message lists: instructions, the turns spoken before the question, then sources and question."""
    asked, hits = chat_hits(spark, sf_dir)
    before = context.history_before(_messages(spark, sf_dir), F.floor(F.col("created_at") / 4)).filter(F.col("role") == "user").select(
        F.concat_ws("/", F.col("session_id").cast("string"), F.col("created_at").cast("string")).alias("query_id"), "history")
    out = context.prompts(asked, context.build_context(hits), before)
    turns = F.slice("messages", 2, F.size("messages") - 2)
    return out.join(asked.select("query_id", "session_id"), "query_id").select(
        "query_id", "session_id", F.coalesce(F.size("messages"), F.lit(0)).cast("long").alias("n_messages"),
        F.coalesce(F.array_join(F.transform(turns, lambda m: F.concat_ws(":", m["role"], m["content"])), "\n"), F.lit("")).alias("said"))


@query(f"""WITH {_SQL_CHAT} SELECT query_id, source_no, doc_id, chunk_id, document_name, round(similarity, 6) AS similarity_score,
  substr(content, 1, 500) AS excerpt, sha256(query_id || '/' || CAST(source_no AS VARCHAR)) AS citation_id FROM kept""")
def citations(spark, sf_dir):
    _, hits = chat_hits(spark, sf_dir)
    return context.citations(context.build_context(hits)).select(
        "citation_id", "query_id", "source_no", "doc_id", "chunk_id", "document_name", F.round("similarity_score", 6).alias("similarity_score"), "excerpt")


@query(f"""WITH {_SQL_CHAT}, n AS (SELECT query_id, count(*) AS n_citations, string_agg(chunk_id, ',' ORDER BY source_no) AS cited FROM kept GROUP BY query_id)
SELECT c.conv_id, c.turn, c.role, c.text AS content, coalesce(n.n_citations, 0) AS n_citations, coalesce(n.cited, '') AS cited
FROM conversations c LEFT JOIN n ON n.query_id = CAST(c.conv_id AS VARCHAR) || '/' || CAST(c.turn - 1 AS VARCHAR) AND c.role = 'assistant'""")
def messages_nested(spark, sf_dir):
    """All messages with their ordered citations; an answer cites for the turn before it."""
    _, hits = chat_hits(spark, sf_dir)
    cited = context.citations(context.build_context(hits)).withColumnRenamed("query_id", "message_id")
    answers = F.when(F.col("role") == "assistant", F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))
    messages = table(spark, sf_dir, "conversations").withColumn("message_id", answers)
    nested = context.messages_with_citations(messages, cited)
    return nested.select(
        "conv_id", "turn", "role", F.col("text").alias("content"), F.size("citations").cast("long").alias("n_citations"),
        F.array_join(F.transform("citations", lambda c: c["chunk_id"]), ",").alias("cited"))


@query(f"""WITH {_SQL_CHAT}, {_SQL_SOURCES}
SELECT q.query_id, q.session_id, 0 AS position, 'user' AS role, q.question AS content, -1.0::DOUBLE AS confidence_score FROM questions q
UNION ALL SELECT q.query_id, q.session_id, 1, 'assistant', CASE WHEN s.query_id IS NULL THEN 'The documents do not contain an answer to this question.' ELSE 'answered' END,
  round(coalesce(s.best, 0.0), 6) FROM questions q LEFT JOIN sources s USING (query_id)""")
def message_rows(spark, sf_dir):
    """User and assistant rows per question; the model's text is outside this job."""
    asked, hits = chat_hits(spark, sf_dir)
    answers = context.prompts(asked, context.build_context(hits)).withColumn("reply", F.coalesce("reply", "outcome"))
    return context.message_rows(asked, answers).select(
        "query_id", "session_id", "position", "role", "content",
        F.coalesce(F.round("confidence_score", 6), F.lit(-1.0)).alias("confidence_score"))


# ------------------------------------------------------------------- history

def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.lit(0).alias("position"), "role", F.col("text").alias("content"))


@query("""SELECT conv_id AS session_id, turn AS created_at, role, text AS content FROM (
  SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) WHERE role IN ('user', 'assistant')""")
def history_last_n(spark, sf_dir):
    return context.recent_history(_messages(spark, sf_dir), 4).drop("position")


@query("""SELECT conv_id AS session_id, count(*) AS n_messages, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS history FROM (
  SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def history_lists(spark, sf_dir):
    lists = context.history_lists(_messages(spark, sf_dir))
    line = F.transform("history", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return lists.select("session_id", F.size("history").cast("long").alias("n_messages"), F.array_join(line, "\n").alias("history"))


@query("""SELECT conv_id, turn, p AS position, m AS marker, m >= 1 AND m <= turn AS valid FROM (
  SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS p, CAST(unnest(l) AS INTEGER) AS m FROM (
    SELECT conv_id, turn, ['0', '1', CAST(turn AS VARCHAR), CAST(turn + 1 AS VARCHAR)] AS l FROM conversations WHERE role = 'assistant'))""")
def citation_marker_check(spark, sf_dir):
    """Answers with four markers added, cited as often as their turn number."""
    n = F.col("turn").cast("string")
    answers = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        F.struct("conv_id", "turn").alias("message_id"), F.col("turn").alias("n_citations"),
        F.concat(F.lit("[0] "), "text", F.lit(" [1] ["), n, F.lit("] ["), (F.col("turn") + 1).cast("string"), F.lit("]")).alias("answer"))
    report = context.marker_report(answers)
    return report.select("message_id.conv_id", "message_id.turn", "position", F.col("marker").cast("int").alias("marker"), "valid")


_SQL_BODY = "conversations WHERE role = 'assistant'"


@query(f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || ' end' ELSE 'none' END AS answer,
  CASE turn % 3 WHEN 2 THEN 'no_answer' ELSE 'answered' END AS outcome FROM {_SQL_BODY}""")
def answer_assembly(spark, sf_dir):
    """Event streams built from the answers, one delta per line, with a malformed and an unfinished frame, read back."""
    from lorewell.sources.transcripts import assemble_answers, event_rows

    frame = lambda kind, delta: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit(kind).alias("type"), delta.alias("delta"))), F.lit("\n\n"))
    lines = F.split("text", "(?<=\n)")
    deltas = F.array_join(F.transform(lines, lambda x: frame("delta", x)), "")
    pick = F.col("turn") % 3
    tail = (
        F.when(pick == 1, F.concat(F.lit("data: {not json\n\n: comment\n\n"), frame("delta", F.lit(" end"))))
        .when(pick == 2, frame("no_answer", F.lit("none"))).otherwise("")
    )
    bodies = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        F.struct("conv_id", "turn").alias("turn_id"), F.concat(deltas, tail, frame("done", F.lit("")), F.lit('data: {"type":"delta","delta":"cut')).alias("body"))
    out = assemble_answers(event_rows(bodies))
    return out.select("turn_id.conv_id", "turn_id.turn", "answer", "outcome")
