"""Table maintenance as batch jobs: deletes, patches, action logs, identity match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import copy_name
from lorewell.operators.ordered import carry_forward
from lorewell.session import cut_lineage

# Child table -> (parent table, child key, parent key) of every cascading reference.
CASCADE = {
    "knowledge_bases": [("users", "owner_id", "id"), ("knowledge_bases", "parent_folder_id", "id")],
    "documents": [("knowledge_bases", "knowledge_base_id", "id"), ("users", "owner_id", "id")],
    "document_chunks": [("documents", "doc_id", "id"), ("knowledge_bases", "kb_id", "id"), ("users", "owner_id", "id")],
    "chat_sessions": [("knowledge_bases", "knowledge_base_id", "id"), ("users", "owner_id", "id")],
    "chat_messages": [("chat_sessions", "session_id", "id"), ("chat_messages", "parent_message_id", "id")],
    "chat_citations": [("chat_messages", "message_id", "id"), ("documents", "document_id", "id"), ("document_chunks", "chunk_id", "chunk_id")],
    "api_usage_logs": [("users", "user_id", "id")],
    "refresh_tokens": [("users", "user_id", "id")],
}
_IDENT = {"document_chunks": "chunk_id"}


def subtree(nodes: DataFrame, roots: DataFrame, ident: str = "id", parent: str = "parent_id", max_rounds: int = 64) -> DataFrame:
    """Ids of ``roots`` and all their descendants.

    A node is settled once it is known whether an ancestor is marked. Only open nodes are
    written again: each round moves an open node's pointer over as many ancestors as it has
    passed so far, so a tree of depth d takes log2(d) rounds, each cut by a reliable checkpoint;
    nodes found marked are appended. n open nodes are settled within log2(n) + 1 rounds or
    lie below a cycle, which is an error.
    """
    marked = cut_lineage(nodes.join(roots.select(ident).distinct(), ident, "left_semi").select(ident))
    hits = [marked]
    state = cut_lineage(nodes.filter(F.col(parent).isNotNull()).join(marked, ident, "left_anti").select(ident, F.col(parent).alias("_up")))
    rounds = min(max_rounds, state.count().bit_length() + 1)
    while not state.isEmpty():
        if not rounds:
            raise ValueError("parent links do not end: the hierarchy has a cycle")
        rounds -= 1
        found = hits[0]
        for more in hits[1:]:
            found = found.unionByName(more)
        # a pointer to neither a marked nor an open node has come to its end
        above = found.select(F.col(ident).alias("_up"), F.lit(None).alias("_next").cast(state.schema["_up"].dataType), F.lit(True).alias("_hit")).unionByName(
            state.select(F.col(ident).alias("_up"), F.col("_up").alias("_next"), F.lit(False).alias("_hit")))
        moved = cut_lineage(state.join(above, "_up").select(ident, F.col("_next").alias("_up"), "_hit"))
        hits.append(moved.filter("_hit").select(ident))
        state = moved.filter(~F.col("_hit")).drop("_hit")
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out


def cascade_delete(tables: dict[str, DataFrame], deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Surviving rows of every table after deleting ``deleted[table](id)``.

    Keys travel down the references table by table; survivors are anti joins, so
    no row of a large child table is collected for a parent. The keys of a table
    are stored once (checkpoint), as both its survivors and its children need
    them. Folders and messages delete their whole subtree; audit rows survive with
    the user cleared.
    """
    gone: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for name in ["users", *CASCADE]:
        if name not in tables:
            continue
        df, ident = tables[name], _IDENT.get(name, "id")
        keys = [deleted[name].select(ident)] if name in deleted else []
        for parent, child_key, parent_key in CASCADE.get(name, []):
            if parent in gone and parent != name and child_key in df.columns:
                dead = gone[parent].select(F.col(parent_key).alias(child_key))
                keys.append(df.join(dead, child_key, "left_semi").select(ident))
        if not keys:
            out[name] = df
            continue
        ids = keys[0]
        for more in keys[1:]:
            ids = ids.unionByName(more)
        for parent, child_key, _ in CASCADE.get(name, []):
            if parent == name and child_key in df.columns:
                ids = subtree(df, ids, ident, child_key)
        gone[name] = cut_lineage(ids.distinct())
        out[name] = df.join(gone[name], ident, "left_anti")
    if "audit_logs" in tables:
        out["audit_logs"] = set_null(tables["audit_logs"], "user_id", gone["users"]) if "users" in gone else tables["audit_logs"]
    return out


def set_null(df: DataFrame, column: str, dead: DataFrame, dead_key: str = "id") -> DataFrame:
    """Clear a reference to deleted rows and keep the row."""
    flags = dead.select(F.col(dead_key).alias(column)).distinct().withColumn("_dead", F.lit(True))
    return (
        df.join(flags, column, "left")
        .withColumn(column, F.when(F.col("_dead").isNull(), F.col(column))).select(*df.columns)
    )


def match_identities(users: DataFrame, incoming: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sign-ins to existing users by external id, else by email, else a new user.

    ``incoming(external_id, email, name, email_verified)``; returns (matched with
    ``user_id, matched_by``, refused because the account is blocked, inserts).
    """
    by_id = users.filter(F.col("external_id").isNotNull()).select(
        "external_id", F.col("id").alias("_id_user"), (F.col("is_suspended") | ~F.col("is_active")).alias("_blocked"))
    by_email = users.select("email", F.col("id").alias("_mail_user"))
    joined = incoming.join(by_id, "external_id", "left").join(by_email, "email", "left").select(
        *incoming.columns,
        F.coalesce("_id_user", "_mail_user").alias("user_id"),
        F.when(F.col("_id_user").isNotNull(), "external_id").when(F.col("_mail_user").isNotNull(), "email").alias("matched_by"),
        F.coalesce("_blocked", F.lit(False)).alias("_blocked"),
    )
    known = joined.filter(F.col("user_id").isNotNull())
    matched = known.filter(~F.col("_blocked")).drop("_blocked").withColumn("last_login_at", as_of)
    refused = known.filter("_blocked").drop("_blocked")
    # several first sign-ins with one address make one user
    fresh = joined.filter(F.col("user_id").isNull()).groupBy("email").agg(
        F.min(F.struct("external_id", "name", "email_verified")).alias("_n")).select("email", "_n.*")
    inserts = fresh.select(
        F.sha2(F.concat_ws("/", F.lit("user"), "email"), 256).alias("id"), "email", F.col("name").alias("full_name"),
        F.lit("user").alias("role"), "external_id", F.col("email_verified").alias("is_verified"),
        F.lit(True).alias("is_active"), F.lit(False).alias("is_suspended"), as_of.alias("last_login_at"),
    )
    return matched, refused, inserts


def link_identities(users: DataFrame, matched: DataFrame) -> DataFrame:
    """Users after their sign-ins: login time, and for a match by email the external id and verification."""
    by_mail = F.col("matched_by") == "email"
    news = matched.groupBy(F.col("user_id").alias("id")).agg(
        F.max("last_login_at").alias("_login"), F.min(F.when(by_mail, F.col("external_id"))).alias("_external"),
        F.coalesce(F.bool_or(by_mail & F.col("email_verified")), F.lit(False)).alias("_verified"))
    return users.join(news, "id", "left").withColumns({
        "last_login_at": F.coalesce("_login", "last_login_at"), "external_id": F.coalesce("_external", "external_id"),
        "is_verified": F.col("is_verified") | F.coalesce("_verified", F.lit(False)),
    }).select(*users.columns)


def disposable_objects(documents: DataFrame, deleted: DataFrame) -> DataFrame:
    """Storage keys left behind by deleted documents (reported, never removed here)."""
    return documents.join(deleted.select("id"), "id", "left_semi").filter(F.col("temp_storage_key").isNotNull()).select("temp_storage_key")


# action -> (flag column, new value); fixed values of the action log
FLAG_ACTIONS = {"suspend": ("is_suspended", True), "unsuspend": ("is_suspended", False), "archive": ("is_archived", True)}
AUDITED = {"suspend": "suspend_user", "delete": "delete_user"}
SELF_FORBIDDEN = ["suspend", "delete"]


def apply_actions(targets: DataFrame, log: DataFrame, flag: str, ident: str = "id") -> dict[str, DataFrame]:
    """Apply ``log(actor, target, action, ts, seq)``.

    The last action per target wins (one aggregate, combined before the
    shuffle). Returns ``updated`` targets, ``rejected`` rows and ``audit`` rows.
    """
    joined = log.join(targets.select(F.col(ident).alias("target"), F.lit(True).alias("_known")), "target", "left")
    reason = (
        F.when(F.col("action").isin(SELF_FORBIDDEN) & (F.col("actor") == F.col("target")), "own account")
        .when(F.col("_known").isNull(), "not found")
    )
    judged = joined.withColumn("reason", reason)
    valid = judged.filter(F.col("reason").isNull())
    effect = F.lit(None).cast("boolean")
    for action, (column, value) in FLAG_ACTIONS.items():
        if column == flag:
            effect = F.when(F.col("action") == action, F.lit(value)).otherwise(effect)
    latest = (
        valid.withColumn("_new", effect).filter(F.col("_new").isNotNull())
        .groupBy("target").agg(F.max_by("_new", F.struct("ts", "seq")).alias("_new"), F.max("ts").alias("_at"))
        .withColumnRenamed("target", ident)
    )
    removed = valid.filter(F.col("action") == "delete").select(F.col("target").alias(ident)).distinct()
    updated = targets.join(removed, ident, "left_anti").join(latest, ident, "left").withColumn(flag, F.coalesce("_new", flag))
    if "updated_at" in targets.columns:
        updated = updated.withColumn("updated_at", F.coalesce("_at", "updated_at"))
    names = F.create_map(*[F.lit(x) for kv in AUDITED.items() for x in kv])
    audit = valid.filter(F.col("action").isin(list(AUDITED))).select(
        F.col("actor").alias("user_id"), names[F.col("action")].alias("action"), F.lit("user").alias("resource_type"),
        F.col("target").cast("string").alias("resource_id"), F.col("ts").alias("created_at"),
    )
    return {
        "updated": updated.select(*targets.columns),
        "rejected": judged.filter(F.col("reason").isNotNull()).select(*log.columns, "reason"),
        "audit": audit,
    }


def apply_patches(df: DataFrame, patches: DataFrame, fields: list[str], ident: str = "id") -> DataFrame:
    """Overwrite exactly the fields named in ``set_fields``; a named NULL overwrites too."""
    fresh = patches.select(ident, "set_fields", *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = df.join(fresh, ident, "left")
    named = lambda f: F.coalesce(F.array_contains("set_fields", f), F.lit(False))
    return joined.withColumns({f: F.when(named(f), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}).select(*df.columns)


def duplicate_knowledge_bases(knowledge_bases: DataFrame, requested: DataFrame, as_of: Column) -> DataFrame:
    """Empty copies: metadata and tags only, no parent, no documents, no counters."""
    zero = F.lit(0).cast("long")
    source = knowledge_bases.join(requested.select("id", "owner_id"), ["id", "owner_id"], "left_semi")
    return source.select(
        F.sha2(F.concat_ws("/", F.lit("copy"), F.col("id").cast("string"), as_of.cast("string")), 256).alias("id"),
        "owner_id", F.lit(None).cast("string").alias("parent_folder_id"), copy_name("name").alias("name"),
        "description", "color", "icon", "tags",
        zero.alias("document_count"), zero.alias("total_chunk_count"), zero.alias("storage_bytes_used"),
    )


def sweep_replayed_tokens(tokens: DataFrame, presented: DataFrame, ts: str = "ts") -> dict[str, DataFrame]:
    """A revoked token presented again revokes every active token of its user.

    ``tokens(token_hash, user_id, revoked, expires_at)``, ``presented(token_hash, ts)``.
    """
    seen = presented.join(tokens, "token_hash", "left")
    verdict = (
        F.when(F.col("user_id").isNull(), "unknown").when(F.col("revoked"), "replayed")
        .when(F.col("expires_at") < F.col(ts), "expired").otherwise("accepted")
    )
    judged = seen.select("token_hash", "user_id", ts, verdict.alias("verdict"))
    victims = judged.filter(F.col("verdict") == "replayed").select("user_id").distinct().withColumn("_hit", F.lit(True))
    updated = tokens.join(victims, "user_id", "left").withColumn(
        "revoked", F.col("revoked") | F.coalesce("_hit", F.lit(False))).select(*tokens.columns)
    return {"verdicts": judged, "tokens": updated, "users": victims.select("user_id")}


# ---------------------------------------------------------------- status log

# Allowed next states; any state may fail.
NEXT_STATUS = {
    "pending": ["virus_scanning"], "virus_scanning": ["extracting"], "extracting": ["chunking"],
    "chunking": ["embedding"], "embedding": ["completed"], "completed": [], "failed": [],
}
STATUS_PROGRESS = {"pending": 0, "virus_scanning": 5, "extracting": 20, "chunking": 50, "embedding": 60, "completed": 100, "failed": 0}


def latest_status(log: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Current state per document from an append-only log."""
    at = F.struct(*order)
    return log.groupBy(key).agg(
        F.max_by("status", at).alias("status"), F.max_by("progress", at).alias("progress"),
        F.max("ts").alias("since"), F.count("*").alias("n_changes"),
    )


def transition_faults(log: DataFrame, key: str = "doc_id", bucket: Column | str | None = None, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Log rows whose step from the previous state is not allowed; the first state must be pending.

    Previous states are found per (document, day) with one summary row per day,
    so a very long log of one document is spread over its days.
    """
    by = bucket if bucket is not None else F.to_date("ts")
    stepped = carry_forward(log, [key], by, list(order), "status", "previous", include_current=False)
    pairs = [(a, b) for a, following in NEXT_STATUS.items() for b in [*following, *(["failed"] if a not in ("completed", "failed") else [])]]
    step = F.concat_ws(">", F.coalesce("previous", F.lit("")), "status")
    return stepped.filter(~step.isin([">pending", *[f"{a}>{b}" for a, b in pairs]]))


def stuck_documents(latest: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Neither completed nor failed and unchanged for ``hours``."""
    idle = F.col("since") < as_of - F.make_dt_interval(hours=F.lit(hours))
    return latest.filter(~F.col("status").isin("completed", "failed") & idle)
