"""Context building: repeated content, token budget, numbering, prompts, citations.

All windows partition by ``query_id`` after top-k, so a group has at most ``k`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import (
    content_key, estimate_tokens, excerpt, numbered_source, source_label, user_turn,
)
from lorewell.operators.ordered import ordered_join, top_per_key

CONTEXT_TOKENS = 3000
HISTORY_MESSAGES = 10
NO_ANSWER = "The documents do not contain an answer to this question."
INSTRUCTIONS = (
    "Answer from the numbered sources only. Name the source of every statement by its number in brackets. "
    "If the sources are not enough, say so."
)


def drop_repeats(hits: DataFrame) -> DataFrame:
    """Of equal content (ignoring case and outer space) keep the best ranked, per question."""
    same = Window.partitionBy("query_id", "_key").orderBy("rank")
    return (
        hits.withColumn("_key", content_key("content")).withColumn("_n", F.row_number().over(same))
        .filter(F.col("_n") == 1).drop("_key", "_n")
    )


def within_budget(hits: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Longest ranked prefix within the budget; the first row always stays.

    Token counts are not negative, so the running sum grows and comparing it
    with the budget cuts exactly at the first overflow.
    """
    ranked = Window.partitionBy("query_id").orderBy("rank")
    return (
        hits.withColumn("tokens", estimate_tokens("content"))
        .withColumn("running_tokens", F.sum("tokens").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.row_number().over(ranked))
        .filter((F.col("running_tokens") <= budget) | (F.col("_n") == 1))
        .drop("_n")
    )


def build_context(hits: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Kept hits with ``source_no`` 1..n in order.

    One exchange by question serves every window here and what follows by question.
    """
    kept = within_budget(drop_repeats(hits.repartition("query_id")), budget)
    return kept.withColumn("source_no", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def prompts(questions: DataFrame, context: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per question: outcome, confidence, prompt text and message list.

    ``history(query_id, history)`` holds earlier turns as ``array<struct<role,content>>``.
    """
    line = F.struct(
        F.col("source_no").alias("seq"),
        numbered_source("source_no", source_label("document_name", "section", "page_number"), "content").alias("text"),
    )
    sources = context.groupBy("query_id").agg(
        ordered_join(line, "\n\n").alias("sources"), F.max("similarity").alias("confidence"), F.count("*").alias("n_sources")
    )
    message = "array<struct<role:string,content:string>>"
    out = questions.select("query_id", "question").join(sources, "query_id", "left")
    if history is not None:
        out = out.join(history.select("query_id", "history"), "query_id", "left")
    else:
        out = out.withColumn("history", F.lit(None).cast(message))
    answered = F.col("n_sources").isNotNull()
    prompt = F.when(answered, user_turn("sources", "question"))
    turn = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    messages = F.concat(
        turn("system", F.lit(INSTRUCTIONS)), F.coalesce("history", F.array().cast(message)), turn("user", F.col("prompt"))
    )
    return (
        out.withColumn("prompt", prompt)
        .select(
            "query_id",
            F.when(answered, "answered").otherwise("no_answer").alias("outcome"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("n_sources", F.lit(0).cast("long")).alias("n_sources"),
            "prompt",
            F.when(answered, messages).alias("messages"),
            F.when(~answered, F.lit(NO_ANSWER)).alias("reply"),
        )
    )


def citations(context: DataFrame) -> DataFrame:
    """Citation facts, one per kept chunk, with the document name copied in."""
    return context.select(
        F.sha2(F.concat_ws("/", F.col("query_id").cast("string"), F.col("source_no").cast("string")), 256).alias("citation_id"),
        "query_id", "source_no", "doc_id", "chunk_id", "document_name", "page_number", "section",
        F.col("similarity").alias("similarity_score"), excerpt("content").alias("excerpt"),
    )


def message_rows(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """User then assistant message of every question.

    ``answers(query_id, outcome, confidence, reply, [model_used, input_tokens,
    output_tokens, latency_ms])``; a no-answer row has no model.
    """
    user = asked.select(
        "query_id", "session_id", F.lit(0).alias("position"), F.lit("user").alias("role"), F.col("question").alias("content"),
        F.lit(None).cast("string").alias("model_used"), F.lit(None).cast("int").alias("input_tokens"),
        F.lit(None).cast("int").alias("output_tokens"), F.lit(None).cast("int").alias("latency_ms"),
        F.lit(None).cast("double").alias("confidence_score"),
    )
    have = set(answers.columns)
    optional = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in
                [("model_used", "string"), ("input_tokens", "int"), ("output_tokens", "int"), ("latency_ms", "int")]]
    reply = answers.join(asked.select("query_id", "session_id"), "query_id").select(
        "query_id", "session_id", F.lit(1).alias("position"), F.lit("assistant").alias("role"), F.col("reply").alias("content"),
        *optional, F.col("confidence").alias("confidence_score"),
    )
    return user.unionByName(reply)


def recent_history(messages: DataFrame, limit: int = HISTORY_MESSAGES) -> DataFrame:
    """Newest ``limit`` messages per session, oldest first; system rows leave after the limit."""
    latest = top_per_key(messages, ["session_id"], [F.desc("created_at"), F.desc("position")], limit, "_n")
    return latest.filter(F.col("role").isin("user", "assistant")).drop("_n")


def history_lists(messages: DataFrame, limit: int = HISTORY_MESSAGES) -> DataFrame:
    kept = recent_history(messages, limit)
    entry = F.struct("created_at", "position", "role", "content")
    return kept.groupBy("session_id").agg(
        F.transform(F.sort_array(F.collect_list(entry)),
                    lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history")
    )


def history_before(messages: DataFrame, bucket: Column | str, limit: int = HISTORY_MESSAGES) -> DataFrame:
    """For every message, the spoken ones among the ``limit`` messages before it in its session.

    Frames are at most ``limit`` rows. ``bucket`` (not decreasing with time) cuts
    a long session: each bucket hands its newest messages on, so a session is
    spread over its buckets.
    """
    part = ["session_id", "_bucket"]
    entry = F.struct("created_at", "position", "role", "content")
    staged = messages.withColumn("_bucket", F.col(bucket) if isinstance(bucket, str) else bucket)
    ends = (
        top_per_key(staged, part, [F.desc("created_at"), F.desc("position")], limit, "_n")
        .groupBy(*part).agg(F.sort_array(F.collect_list(entry)).alias("_end"))
    )
    # every bucket holds a message, so `limit` buckets back hold enough
    back = Window.partitionBy("session_id").orderBy("_bucket").rowsBetween(-limit, -1)
    newest = lambda items: F.slice(items, F.greatest(F.size(items) - limit + 1, F.lit(1)), limit)
    handed = ends.select(*part, newest(F.flatten(F.collect_list("_end").over(back))).alias("_handed"))
    inside = Window.partitionBy(*part).orderBy("created_at", "position").rowsBetween(-limit, -1)
    seen = F.concat("_handed", F.collect_list(entry).over(inside))
    spoken = F.filter(newest(seen), lambda m: m["role"].isin("user", "assistant"))
    return (
        staged.join(handed, part)
        .withColumn("history", F.transform(spoken, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
        .select(*messages.columns, "history")
    )


def messages_with_citations(messages: DataFrame, cited: DataFrame, key: str = "message_id") -> DataFrame:
    """Messages with their ordered citations; none gives an empty list. A message cites at most ``k`` chunks."""
    fields = ["source_no", "doc_id", "chunk_id", "document_name", "page_number", "section", "similarity_score", "excerpt"]
    entry = F.struct(*[c for c in fields if c in cited.columns])
    lists = cited.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("citations"))
    kind = lists.schema["citations"].dataType.simpleString()
    return messages.join(lists, key, "left").withColumn("citations", F.coalesce("citations", F.array().cast(kind)))


def marker_report(answers: DataFrame, n_citations: str = "n_citations", text: str = "answer", key: str = "message_id") -> DataFrame:
    """Every ``[n]`` marker of an answer and whether such a citation exists."""
    from lorewell.functions.text import citation_markers

    return answers.select(key, n_citations, F.posexplode(citation_markers(text)).alias("position", "marker")).select(
        key, "position", "marker", ((F.col("marker") >= 1) & (F.col("marker") <= F.col(n_citations))).alias("valid"),
    )
