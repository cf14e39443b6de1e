"""Dashboards, listings and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions import display, rules, text
from lorewell.operators import analytics, counters, listing, maintenance
from lorewell.plans import query, views
from lorewell.plans.views import SQL_CHUNKS, SQL_DOCS, SQL_SESSIONS, SQL_USAGE
from lorewell.session import shared_folder, table
from lorewell.sources.manifest import confirm_sizes, confirm_uploads, expired_uploads
from lorewell.streaming import counters as stored

AS_OF = "2024-02-01 00:00:00"


def _shown(entries):
    """Map entries as text, for comparison."""
    return F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


_SQL_STATUS_TEXT = "string_agg(status || '=' || CAST(n AS VARCHAR), ',' ORDER BY status)"
_SQL_KBS = """kbs AS (SELECT kb_id, owner_id, count(*) AS document_count, CAST(sum(size_bytes) AS BIGINT) AS storage_bytes_used FROM docs GROUP BY ALL)"""


# ---------------------------------------------------------------- dashboards

@query(f"""WITH {SQL_DOCS}, {SQL_USAGE}, {_SQL_KBS}, {SQL_CHUNKS}, {SQL_SESSIONS}, s AS (SELECT status, count(*) AS n FROM docs GROUP BY status)
SELECT (SELECT count(*) FROM customer) AS total_users, (SELECT count(*) FROM kbs) AS total_knowledge_bases,
  (SELECT count(*) FROM chunks) AS total_chunks, (SELECT CAST(sum(storage_bytes_used) AS BIGINT) FROM kbs) AS total_storage_bytes,
  (SELECT count(*) FROM docs) AS total_documents, (SELECT count(*) FROM sessions) AS total_chat_sessions,
  (SELECT count(*) FROM logs WHERE created_at >= (SELECT max(created_at) FROM logs) - INTERVAL 24 HOUR) AS api_calls_last_24h,
  (SELECT count(*) FROM logs WHERE status_code >= 400 AND created_at >= (SELECT max(created_at) FROM logs) - INTERVAL 24 HOUR) AS api_errors_last_24h,
  (SELECT {_SQL_STATUS_TEXT} FROM s) AS documents_by_status""")
def analytics_summary(spark, sf_dir):
    """The dashboard over the stored counters, which the arrival of each document has raised."""
    root = shared_folder(spark, "counters")
    arrived = views.counted_documents(spark, sf_dir)
    stored.write_delta(arrived.select(F.lit(None).cast(counters.IMAGE).alias("before"), F.struct(*arrived.columns[1:]).cast(counters.IMAGE).alias("after")), root, 0)
    out = counters.dashboard(
        stored.read_counters(spark, root), table(spark, sf_dir, "customer"), views.sessions(spark, sf_dir), views.usage(spark, sf_dir), views.last_event(spark, sf_dir))
    return out.withColumn("documents_by_status", _shown("documents_by_status"))


@query(f"WITH {SQL_DOCS}, s AS (SELECT status, count(*) AS n FROM docs GROUP BY status) SELECT {_SQL_STATUS_TEXT} AS documents_by_status, CAST(sum(n) AS BIGINT) AS total_documents FROM s")
def status_map(spark, sf_dir):
    out = analytics.status_map(views.documents(spark, sf_dir))
    return out.withColumn("documents_by_status", _shown("documents_by_status"))


@query(f"""WITH {SQL_DOCS}, {_SQL_KBS}, {SQL_SESSIONS}, s AS (SELECT kb_id, status, count(*) AS n FROM docs GROUP BY ALL),
m AS (SELECT kb_id, {_SQL_STATUS_TEXT} AS documents_by_status FROM s GROUP BY kb_id), c AS (SELECT kb_id, count(*) AS n FROM sessions GROUP BY kb_id)
SELECT k.kb_id, k.owner_id, k.document_count, k.storage_bytes_used, m.documents_by_status, coalesce(c.n, 0) AS chat_session_count
FROM kbs k LEFT JOIN m USING (kb_id) LEFT JOIN c USING (kb_id)""")
def kb_stats(spark, sf_dir):
    out = analytics.knowledge_base_stats(views.knowledge_bases(spark, sf_dir), views.documents(spark, sf_dir), views.sessions(spark, sf_dir))
    return out.withColumn("documents_by_status", _shown("documents_by_status"))


@query(f"""WITH {SQL_DOCS}, {_SQL_KBS}, u AS (SELECT DISTINCT 'own' || CAST(n_nationkey AS VARCHAR) AS owner_id FROM nation),
k AS (SELECT owner_id, count(*) AS n, CAST(sum(storage_bytes_used) AS BIGINT) AS b FROM kbs GROUP BY owner_id), d AS (SELECT owner_id, count(*) AS n FROM docs GROUP BY owner_id)
SELECT u.owner_id, coalesce(k.n, 0) AS knowledge_base_count, coalesce(d.n, 0) AS document_count, coalesce(k.b, 0) AS total_storage_bytes
FROM u LEFT JOIN k USING (owner_id) LEFT JOIN d USING (owner_id)""")
def user_detail(spark, sf_dir):
    users = table(spark, sf_dir, "nation").select(F.concat(F.lit("own"), F.col("n_nationkey").cast("string")).alias("owner_id"))
    return analytics.user_detail(users, views.knowledge_bases(spark, sf_dir), views.documents(spark, sf_dir))


@query(f"""WITH {SQL_DOCS}, {_SQL_KBS} SELECT owner_id, count(*) AS knowledge_base_count, CAST(sum(document_count) AS BIGINT) AS document_count,
  CAST(sum(storage_bytes_used) AS BIGINT) AS storage_bytes FROM kbs GROUP BY owner_id""")
def owner_rollup(spark, sf_dir):
    return analytics.owner_rollup(views.knowledge_bases(spark, sf_dir))


@query(f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, a AS (SELECT kb_id, count(*) FILTER (WHERE status = 'completed') AS d, CAST(sum(size_bytes) AS BIGINT) AS b FROM docs GROUP BY kb_id),
c AS (SELECT kb_id, count(*) AS n FROM chunks GROUP BY kb_id)
SELECT kb_id, d AS document_count, b AS storage_bytes_used, coalesce(n, 0) AS total_chunk_count FROM a LEFT JOIN c USING (kb_id)""")
def counters_recomputed(spark, sf_dir):
    return analytics.document_counters(views.documents(spark, sf_dir), views.corpus_chunks(spark, sf_dir))


@query(f"""WITH {SQL_DOCS}, a AS (SELECT kb_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS d, CAST(sum(size_bytes) AS BIGINT) AS b FROM docs GROUP BY kb_id)
SELECT kb_id, n - d AS drift_document_count, -b AS drift_storage_bytes_used FROM a WHERE n <> d OR b <> 0""")
def counter_drift(spark, sf_dir):
    """Counters kept as the service does (every upload counted, bytes never written) against the facts."""
    docs = views.documents(spark, sf_dir)
    kept = docs.groupBy("kb_id").agg(F.count("*").alias("document_count"), F.lit(0).cast("long").alias("storage_bytes_used"))
    actual = docs.groupBy("kb_id").agg(
        F.count_if(F.col("status") == "completed").alias("document_count"), F.sum("size_bytes").alias("storage_bytes_used"))
    return analytics.counter_drift(kept, actual, ["document_count", "storage_bytes_used"])


@query(f"""WITH {SQL_DOCS} SELECT kb_id, bool_or(status NOT IN ('completed', 'failed')) AS still_processing,
  count(*) FILTER (WHERE status NOT IN ('completed', 'failed')) AS n_processing FROM docs GROUP BY kb_id""")
def still_processing(spark, sf_dir):
    return listing.processing_by(views.documents(spark, sf_dir), "kb_id")


# ------------------------------------------------------------------ listings

def _users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.lower(F.regexp_replace("c_name", "#", "@")).alias("email"), F.col("c_name").alias("full_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role"),
        (F.col("c_acctbal") >= 0).alias("is_active"), (F.col("c_acctbal") > 9000).alias("is_suspended"),
        F.timestamp_micros(F.unix_micros(F.lit(views.EPOCH).cast("timestamp")) + F.col("c_custkey") % 97 * 3_600_000_000).alias("created_at"),
        F.when(F.col("c_nationkey") < 5, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).alias("external_id"))


_SQL_USERS = f"""users AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '@')) AS email, c_name AS full_name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role, c_acctbal >= 0 AS is_active, c_acctbal > 9000 AS is_suspended,
  TIMESTAMP '{views.EPOCH}' + to_hours(CAST(c_custkey % 97 AS INTEGER)) AS created_at,
  CASE WHEN c_nationkey < 5 THEN 'x' || CAST(c_custkey AS VARCHAR) END AS external_id FROM customer)"""


def _ntz(col):
    return F.to_timestamp_ntz(F.date_format(col, "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {_SQL_USERS} SELECT id, email, role FROM users WHERE email ILIKE '%0_7%' AND role = 'admin'")
def search_ilike(spark, sf_dir):
    return listing.search(_users(spark, sf_dir), "email", "0_7", {"role": "admin", "full_name": ""}).select("id", "email", "role")


@query(f"WITH {_SQL_USERS} SELECT count(*) AS total FROM users WHERE email ILIKE '%0_7%' AND role = 'admin'")
def search_total(spark, sf_dir):
    return listing.search(_users(spark, sf_dir), "email", "0_7", {"role": "admin"}).agg(F.count("*").alias("total"))


@query(f"WITH {_SQL_USERS} SELECT id, email, created_at FROM users ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def page_offset(spark, sf_dir):
    page = listing.newest(_users(spark, sf_dir), "created_at", "id", limit=50, offset=100)
    return page.select("id", "email", _ntz("created_at").alias("created_at"))


@query(f"WITH {SQL_DOCS} SELECT doc_id, kb_id, name, language, size_bytes, status, created_at FROM docs ORDER BY created_at DESC, doc_id")
def documents_newest(spark, sf_dir):
    docs = listing.newest(views.documents(spark, sf_dir), "created_at", "doc_id")
    return docs.select("doc_id", "kb_id", "name", "language", "size_bytes", "status", _ntz("created_at").alias("created_at"))


@query("""SELECT o_orderkey AS id, o_custkey AS owner_id, o_orderstatus = 'F' AS is_pinned, o_orderdate AS updated_at FROM orders WHERE o_orderpriority <> '5-LOW'
ORDER BY is_pinned DESC, updated_at DESC, id LIMIT 200""")
def pinned_sort(spark, sf_dir):
    """First page of sessions, pinned first, archived ones hidden."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), (F.col("o_orderstatus") == "F").alias("is_pinned"),
        F.col("o_orderdate").alias("updated_at"), (F.col("o_orderpriority") == "5-LOW").alias("is_archived"))
    return listing.pinned_first(listing.visible(rows)).limit(200).drop("is_archived")


@query("""SELECT l.l_orderkey AS id, l.l_linenumber AS line, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey = l.l_partkey % 1000) AS is_owned FROM lineitem l""")
def ownership_lookup(spark, sf_dir):
    """Requests for (id, owner): found and owned, or not found."""
    asked = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 1000).alias("owner_id"), F.col("l_linenumber").alias("line"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"))
    return listing.owned(asked, known, ["id", "owner_id"]).withColumnRenamed("owned", "is_owned").drop("owner_id")


@query(f"""WITH {_SQL_USERS} SELECT id, email, full_name, role, is_active, is_suspended, created_at, is_suspended OR NOT is_active AS is_blocked,
  CASE WHEN id % 3 = 0 THEN 'New Chat' ELSE full_name END AS title FROM users""")
def public_users(spark, sf_dir):
    users = _users(spark, sf_dir)
    cols = [c for c in listing.PUBLIC["users"] if c in users.columns and c != "created_at"]
    title = text.or_default(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("full_name")), "New Chat")
    return users.select(*cols, _ntz("created_at").alias("created_at"), rules.is_blocked("is_suspended", "is_active").alias("is_blocked"), title.alias("title"))


@query(f"""WITH {SQL_DOCS}, {_SQL_KBS}, k AS (SELECT kb_id, owner_id, max(created_at) AS updated_at, bool_and(status = 'completed') AS is_archived FROM docs GROUP BY ALL)
SELECT kb_id, owner_id, updated_at FROM k WHERE NOT is_archived AND kb_id ILIKE '%rc1%' ORDER BY updated_at DESC, kb_id""")
def kb_listing(spark, sf_dir):
    """Knowledge bases by last change, archived ones hidden, with a name search."""
    kbs = views.documents(spark, sf_dir).groupBy("kb_id", "owner_id").agg(
        F.max("created_at").alias("updated_at"), F.bool_and(F.col("status") == "completed").alias("is_archived"))
    found = listing.newest(listing.search(listing.visible(kbs), "kb_id", "RC1"), "updated_at", "kb_id")
    return found.select("kb_id", "owner_id", _ntz("updated_at").alias("updated_at"))


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn")
def messages_chronological(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


@query(f"""WITH {SQL_DOCS} SELECT doc_id, CASE status WHEN 'pending' THEN 'waiting' WHEN 'completed' THEN 'ready' ELSE status END AS label,
  status NOT IN ('completed', 'failed') AS still_processing FROM docs""")
def status_labels(spark, sf_dir):
    return views.documents(spark, sf_dir).select(
        "doc_id", display.status_label("status").alias("label"), rules.is_still_processing("status").alias("still_processing"))


@query(f"""WITH {SQL_DOCS} SELECT doc_id, kb_id, name FROM docs WHERE kb_id = 'src7' AND owner_id = 'own3' AND language = 'en'
  AND created_at >= TIMESTAMP '2024-01-01 00:30:00' AND created_at <= TIMESTAMP '2024-01-03 00:00:00'""")
def tenant_filter(spark, sf_dir):
    """One tenant with language and date filters, as predicates on the scan; empty filters are absent."""
    from lorewell.operators.retrieval import scoped_filter

    stamp = lambda s: F.lit(s).cast("timestamp")
    found = scoped_filter(views.documents(spark, sf_dir), "src7", "own3", doc_ids=[], language="en",
                          uploaded_after=stamp("2024-01-01 00:30:00"), uploaded_before=stamp("2024-01-03 00:00:00"))
    return found.select("doc_id", "kb_id", "name")


# --------------------------------------------------------------- maintenance

def _service_tables(spark, sf_dir):
    """Customers as users, orders as knowledge bases, line items as documents; chunks, chats and logs hang below."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    kbs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), "o_orderstatus")
    item = F.col("l_orderkey") * 100_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    docs = table(spark, sf_dir, "lineitem").select(item.alias("id"), F.col("l_orderkey").alias("knowledge_base_id"))
    messages = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"))
    chats = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7 % 15000).alias("knowledge_base_id"))
    audit = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"))
    chunks = docs.select((F.col("id") * 10 + 1).alias("chunk_id"), F.col("id").alias("doc_id"), F.col("knowledge_base_id").alias("kb_id"))
    citations = docs.select("id", F.col("knowledge_base_id").alias("message_id"), F.col("id").alias("document_id"))
    usage = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("endpoint"))
    tokens = kbs.select("id", F.col("owner_id").alias("user_id"))
    return {"users": users, "knowledge_bases": kbs, "documents": docs, "document_chunks": chunks, "chat_sessions": chats, "chat_messages": messages,
            "chat_citations": citations, "api_usage_logs": usage, "refresh_tokens": tokens, "audit_logs": audit}


@query("""WITH u AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0),
k AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM u)),
d AS (SELECT l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS id, l_orderkey FROM lineitem),
s AS (SELECT o_orderkey AS id, o_orderkey * 7 % 15000 AS kb FROM orders)
SELECT 'users' AS table_name, count(*) AS n_rows, CAST(sum(c_custkey) AS BIGINT) AS id_sum FROM customer WHERE c_custkey NOT IN (SELECT id FROM u)
UNION ALL SELECT 'knowledge_bases', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM k)
UNION ALL SELECT 'documents', count(*), CAST(sum(id % 1000003) AS BIGINT) FROM d WHERE l_orderkey NOT IN (SELECT id FROM k)
UNION ALL SELECT 'chat_sessions', count(*), CAST(sum(id) AS BIGINT) FROM s WHERE kb NOT IN (SELECT id FROM k)
UNION ALL SELECT 'chat_messages', count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE user_id NOT IN (SELECT id FROM s WHERE kb IN (SELECT id FROM k))
UNION ALL SELECT 'document_chunks', count(*), CAST(sum((id * 10 + 1) % 1000003) AS BIGINT) FROM d WHERE l_orderkey NOT IN (SELECT id FROM k)
UNION ALL SELECT 'chat_citations', count(*), CAST(sum(id % 1000003) AS BIGINT) FROM d WHERE l_orderkey NOT IN (SELECT id FROM k)
  AND l_orderkey NOT IN (SELECT event_id FROM events WHERE user_id IN (SELECT id FROM s WHERE kb IN (SELECT id FROM k)))
UNION ALL SELECT 'api_usage_logs', count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE user_id NOT IN (SELECT id FROM u)
UNION ALL SELECT 'refresh_tokens', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_custkey NOT IN (SELECT id FROM u)
UNION ALL SELECT 'audit_logs', count(*), CAST(sum(event_id * CASE WHEN user_id IN (SELECT id FROM u) THEN 0 ELSE 1 END) AS BIGINT) FROM events""")
def cascade_delete(spark, sf_dir):
    """Delete every user in debt and all that hangs below; what remains, per table."""
    tables = _service_tables(spark, sf_dir)
    dead = {"users": tables["users"].filter(F.col("c_acctbal") < 0).select("id")}
    left = maintenance.cascade_delete(tables, dead)
    out = None
    idents = {"documents": F.expr("id % 1000003"), "chat_citations": F.expr("id % 1000003"), "document_chunks": F.expr("chunk_id % 1000003"), "audit_logs": F.expr("IF(user_id IS NULL, 0, id)")}
    for name, df in left.items():
        counted = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.sum(idents.get(name, F.col("id"))).alias("id_sum"))
        out = counted if out is None else out.unionByName(counted)
    return out.select("table_name", "n_rows", "id_sum")


@query("""SELECT event_id AS id, CASE WHEN c_custkey IS NULL THEN user_id ELSE -1 END AS user_id, event_type AS action
FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON c_custkey = user_id""")
def set_null(spark, sf_dir):
    tables = _service_tables(spark, sf_dir)
    dead = tables["users"].filter(F.col("c_acctbal") < 0)
    return maintenance.set_null(tables["audit_logs"], "user_id", dead).withColumn("user_id", F.coalesce("user_id", F.lit(-1).cast("long")))


@query("""WITH RECURSIVE tree AS (
  SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9500
  UNION SELECT c.c_custkey FROM customer c JOIN tree t ON c.c_custkey // 4 = t.id AND c.c_custkey > 0)
SELECT id FROM tree""")
def subtree(spark, sf_dir):
    """Folders to delete with all descendants; the parent of folder n is n / 4."""
    nodes = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 4)).alias("parent_id"), "c_acctbal")
    return maintenance.subtree(nodes, nodes.filter(F.col("c_acctbal") > 9500))


@query(f"""WITH {_SQL_USERS}, inc AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'x' || CAST(o_custkey AS VARCHAR) ELSE 'y' || CAST(o_orderkey AS VARCHAR) END AS external_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'new' || CAST(o_orderkey AS VARCHAR) || '@example.org' ELSE 'customer@' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS email, o_orderkey FROM orders),
j AS (SELECT i.*, a.id AS by_id, a.is_suspended OR NOT a.is_active AS blocked, e.id AS by_mail FROM inc i LEFT JOIN users a ON a.external_id = i.external_id LEFT JOIN users e ON e.email = i.email)
SELECT o_orderkey, CASE WHEN by_id IS NOT NULL AND blocked THEN 'refused' WHEN by_id IS NOT NULL THEN 'external_id' WHEN by_mail IS NOT NULL THEN 'email' ELSE 'insert' END AS outcome,
  coalesce(by_id, by_mail, -1) AS user_id FROM j""")
def two_key_match(spark, sf_dir):
    """Sign-ins matched by external id, else email, else inserted."""
    key = F.col("o_orderkey")
    incoming = table(spark, sf_dir, "orders").select(
        F.when(key % 3 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("y"), key.cast("string"))).alias("external_id"),
        F.when(key % 5 == 0, F.concat(F.lit("new"), key.cast("string"), F.lit("@example.org"))).otherwise(
            F.concat(F.lit("customer@"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("email"),
        key.cast("string").alias("name"), F.lit(True).alias("email_verified"))
    matched, refused, inserts = maintenance.match_identities(_users(spark, sf_dir), incoming, F.lit(AS_OF).cast("timestamp"))
    row = lambda df, name, outcome, user: df.select(F.col(name).cast("long").alias("o_orderkey"), outcome.alias("outcome"), user.alias("user_id"))
    return (
        row(matched, "name", F.col("matched_by"), F.col("user_id"))
        .unionByName(row(refused, "name", F.lit("refused"), F.col("user_id")))
        .unionByName(row(inserts, "full_name", F.lit("insert"), F.lit(-1).cast("long")))
    )


_SQL_ACTIONS = """acts AS (SELECT event_id AS seq, ts, user_id AS actor, event_id * 7 % 1600 AS target,
  CASE event_type WHEN 'click' THEN 'suspend' WHEN 'view' THEN 'unsuspend' WHEN 'purchase' THEN 'suspend' WHEN 'signup' THEN CASE WHEN event_id % 9 = 0 THEN 'delete' ELSE 'archive' END ELSE 'archive' END AS action FROM events),
judged AS (SELECT a.*, CASE WHEN action IN ('suspend', 'delete') AND actor = target THEN 'own account' WHEN c_custkey IS NULL THEN 'not found' END AS reason
  FROM acts a LEFT JOIN customer ON c_custkey = target)"""


def _applied(spark, sf_dir):
    event = F.col("event_type")
    action = (
        F.when(event.isin("click", "purchase"), "suspend").when(event == "view", "unsuspend")
        .when((event == "signup") & (F.col("event_id") % 9 == 0), "delete").otherwise("archive")
    )
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("actor"), (F.col("event_id") * 7 % 1600).alias("target"), action.alias("action"), "ts", F.col("event_id").alias("seq"))
    targets = _users(spark, sf_dir).select("id", "email", "is_suspended")
    return maintenance.apply_actions(targets, log, "is_suspended")


@query(f"""WITH {_SQL_USERS}, {_SQL_ACTIONS},
latest AS (SELECT target, arg_max(action = 'suspend', (ts, seq)) AS flag FROM judged WHERE reason IS NULL AND action IN ('suspend', 'unsuspend') GROUP BY target)
SELECT id, email, coalesce(flag, is_suspended) AS is_suspended FROM users LEFT JOIN latest ON target = id
WHERE id NOT IN (SELECT target FROM judged WHERE reason IS NULL AND action = 'delete')""")
def action_log(spark, sf_dir):
    return _applied(spark, sf_dir)["updated"]


@query(f"""WITH {_SQL_ACTIONS} SELECT seq, reason, '' AS audit FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT seq, '', CASE action WHEN 'suspend' THEN 'suspend_user' ELSE 'delete_user' END FROM judged WHERE reason IS NULL AND action IN ('suspend', 'delete')""")
def action_log_outcomes(spark, sf_dir):
    """Rejected actions with the reason, and the audit rows of the others."""
    out = _applied(spark, sf_dir)
    rejected = out["rejected"].select("seq", "reason", F.lit("").alias("audit"))
    # the audit row keeps time and target; the log's number is found by both
    seqs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("created_at"), (F.col("event_id") * 7 % 1600).cast("string").alias("resource_id"))
    audit = out["audit"].join(seqs, ["created_at", "resource_id"]).select("seq", F.lit("").alias("reason"), F.col("action").alias("audit"))
    return rejected.unionByName(audit)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'renamed ' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS name,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'none' ELSE c_mktsegment END AS description FROM customer""")
def partial_update(spark, sf_dir):
    """Every third row renamed; every sixth also has its description set to NULL."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))
    third, sixth = F.col("id") % 3 == 0, F.col("id") % 6 == 0
    patches = rows.select(
        "id", F.when(sixth, F.array(F.lit("name"), F.lit("description"))).when(third, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")).alias("set_fields"),
        F.concat(F.lit("renamed "), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("description"))
    return maintenance.apply_patches(rows, patches, ["name", "description"]).withColumn("description", F.coalesce("description", F.lit("none")))


@query("""SELECT o_custkey AS owner_id, CAST(o_orderkey AS VARCHAR) || ' (copy)' AS name, o_orderpriority AS description, CAST(0 AS BIGINT) AS document_count,
  CASE WHEN o_orderkey % 3 = 0 THEN '0:' ELSE '2:' || o_orderstatus || ',' || o_orderpriority END AS tags
FROM orders WHERE o_custkey % 2 = 0""")
def duplicate_rows(spark, sf_dir):
    """Copies asked for by owners with an even number; requests by others own nothing."""
    null = F.lit(None).cast("string")
    kbs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").cast("string").alias("name"),
        F.col("o_orderpriority").alias("description"), null.alias("color"), null.alias("icon"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus", "o_orderpriority")).alias("tags"))
    asked = kbs.select("id", F.when(F.col("owner_id") % 2 == 0, F.col("owner_id")).otherwise(-1).alias("owner_id"))
    copies = maintenance.duplicate_knowledge_bases(kbs, asked, F.lit(AS_OF).cast("timestamp"))
    tags = F.concat(F.size("tags").cast("string"), F.lit(":"), F.array_join("tags", ","))
    return copies.select("owner_id", "name", "description", "document_count", tags.alias("tags"))


@query("""WITH t AS (SELECT 't' || CAST(o_orderkey AS VARCHAR) AS h, o_custkey AS user_id, o_orderstatus = 'F' AND o_totalprice > 450000 AS revoked, o_orderdate + INTERVAL 30 DAY AS expires_at, o_orderkey FROM orders),
p AS (SELECT 't' || CAST(l_orderkey AS VARCHAR) AS h, l_shipdate AS ts FROM lineitem),
v AS (SELECT p.h, t.user_id, CASE WHEN t.user_id IS NULL THEN 'unknown' WHEN t.revoked THEN 'replayed' WHEN t.expires_at < p.ts THEN 'expired' ELSE 'accepted' END AS verdict FROM p LEFT JOIN t ON t.h = p.h)
SELECT h AS token_hash, user_id, revoked OR user_id IN (SELECT user_id FROM v WHERE verdict = 'replayed') AS revoked FROM t""")
def token_replay_sweep(spark, sf_dir):
    tokens = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("token_hash"), F.col("o_custkey").alias("user_id"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 450_000)).alias("revoked"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    shown = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("token_hash"), F.col("l_shipdate").alias("ts"))
    return maintenance.sweep_replayed_tokens(tokens, shown)["tokens"].select("token_hash", "user_id", "revoked")


@query(f"""WITH {SQL_DOCS} SELECT doc_id, CASE status WHEN 'pending' THEN '' ELSE 'already ' || status END AS reject_reason,
  CASE status WHEN 'pending' THEN 'virus_scanning' ELSE status END AS next_status FROM docs""")
def confirm_pending(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return confirm_uploads(docs, docs.select("doc_id")).select("doc_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"), "next_status")


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN n_chars ELSE length(text) + doc_id % 2 END AS original_size_bytes,
  doc_id % 10 = 3 AS missing, coalesce(doc_id % 10 <> 3 AND length(text) + doc_id % 2 <> n_chars, false) AS size_mismatch FROM documents""")
def stored_sizes(spark, sf_dir):
    """Reported against stored sizes; some objects never arrived, some are a byte longer."""
    docs = table(spark, sf_dir, "documents")
    registered = docs.select(F.col("doc_id").alias("storage_key"), F.col("n_chars").alias("original_size_bytes"))
    stored = docs.filter(F.col("doc_id") % 10 != 3).select(
        F.col("doc_id").alias("storage_key"), (F.char_length("text").cast("long") + F.col("doc_id") % 2).alias("length"))
    out = confirm_sizes(registered, stored)
    return out.select(F.col("storage_key").alias("doc_id"), "original_size_bytes", "missing", F.coalesce("size_mismatch", F.lit(False)).alias("size_mismatch"))


@query(f"""WITH {SQL_DOCS} SELECT doc_id FROM docs WHERE status <> 'completed' AND created_at < (SELECT max(created_at) FROM docs) - INTERVAL 7 DAY + INTERVAL 160 HOUR""")
def orphan_uploads(spark, sf_dir):
    """Uploads seven days old at a time 160 hours after the newest one, not completed."""
    docs = views.documents(spark, sf_dir)
    newest = F.lit(docs.agg(F.max("created_at").alias("m")).first()["m"]) + F.expr("INTERVAL 160 HOURS")
    stored = docs.select("doc_id", F.col("created_at").alias("modificationTime"))
    done = docs.filter(F.col("status") == "completed")
    return expired_uploads(stored, done, newest, key="doc_id").select("doc_id")


@query(f"""WITH {SQL_DOCS}, {SQL_SESSIONS} SELECT s.session_id, s.kb_id, EXISTS (SELECT 1 FROM docs d WHERE d.kb_id = s.kb_id AND d.owner_id = s.owner_id) AS allowed FROM sessions s""")
def session_ownership(spark, sf_dir):
    """A session may be opened on an owned knowledge base only."""
    sessions = listing.owned(views.sessions(spark, sf_dir), views.knowledge_bases(spark, sf_dir), ["kb_id", "owner_id"])
    return sessions.select("session_id", "kb_id", F.col("owned").alias("allowed"))
