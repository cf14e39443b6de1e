"""Counts, status maps, usage windows, alarms and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import _c

ERROR_STATUS = 400
ALARM_PERIOD_SECONDS = 300
ALARM_THRESHOLD = 20
ALARM_PERIODS = 2


def status_map(documents: DataFrame, keys: list[str] | None = None, status: str = "status") -> DataFrame:
    """Documents per status as a map; a status without documents has no key.

    Counted per status first, so what is collected into the map is one entry per status value.
    """
    keys = keys or []
    counts = documents.groupBy(*keys, status).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(status, "_n")))).alias("documents_by_status"),
        F.sum("_n").alias("total_documents"),
    )


def since(ts: Column | str, as_of: Column, hours: int = 24) -> Column:
    """Inclusive trailing window without an upper bound."""
    return _c(ts) >= as_of - F.make_dt_interval(hours=F.lit(hours))


def usage_window(usage: DataFrame, as_of: Column, hours: int = 24, ts: str = "created_at") -> DataFrame:
    """Calls and errors of the trailing window, in one scan."""
    return usage.filter(since(ts, as_of, hours)).agg(
        F.count("*").alias("api_calls"), F.count_if(F.col("status_code") >= ERROR_STATUS).alias("api_errors")
    )


def analytics_summary(
    users: DataFrame, knowledge_bases: DataFrame, documents: DataFrame, sessions: DataFrame, usage: DataFrame, as_of: Column
) -> DataFrame:
    """The one-row dashboard: five aggregate scans, their single rows laid over each other."""
    parts = [
        users.agg(F.count("*").alias("total_users")),
        knowledge_bases.agg(
            F.count("*").alias("total_knowledge_bases"),
            F.coalesce(F.sum("total_chunk_count"), F.lit(0)).alias("total_chunks"),
            F.coalesce(F.sum("storage_bytes_used"), F.lit(0)).alias("total_storage_bytes"),
        ),
        status_map(documents),
        sessions.agg(F.count("*").alias("total_chat_sessions")),
        usage_window(usage, as_of).withColumnsRenamed({"api_calls": "api_calls_last_24h", "api_errors": "api_errors_last_24h"}),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])
    empty = F.create_map().cast("map<string,bigint>")
    return out.withColumns({
        "documents_by_status": F.coalesce("documents_by_status", empty),
        "total_documents": F.coalesce("total_documents", F.lit(0).cast("long")),
    })


def knowledge_base_stats(knowledge_bases: DataFrame, documents: DataFrame, sessions: DataFrame) -> DataFrame:
    """Stats of all knowledge bases in one pass; each side is aggregated before the join."""
    by_status = status_map(documents, ["kb_id"]).drop("total_documents")
    chats = sessions.groupBy("kb_id").agg(F.count("*").alias("chat_session_count"))
    return (
        knowledge_bases.join(by_status, "kb_id", "left").join(chats, "kb_id", "left")
        .withColumns({
            "chat_session_count": F.coalesce("chat_session_count", F.lit(0).cast("long")),
            "documents_by_status": F.coalesce("documents_by_status", F.create_map().cast("map<string,bigint>")),
        })
    )


def user_detail(users: DataFrame, knowledge_bases: DataFrame, documents: DataFrame) -> DataFrame:
    """Knowledge bases, documents and bytes per user; zero where a user has none."""
    zero = F.lit(0).cast("long")
    kbs = knowledge_bases.groupBy("owner_id").agg(
        F.count("*").alias("knowledge_base_count"), F.sum("storage_bytes_used").alias("total_storage_bytes"))
    docs = documents.groupBy("owner_id").agg(F.count("*").alias("document_count"))
    return users.join(kbs, "owner_id", "left").join(docs, "owner_id", "left").withColumns({
        c: F.coalesce(c, zero) for c in ("knowledge_base_count", "document_count", "total_storage_bytes")
    })


def owner_rollup(knowledge_bases: DataFrame) -> DataFrame:
    return knowledge_bases.groupBy("owner_id").agg(
        F.count("*").alias("knowledge_base_count"), F.sum("document_count").alias("document_count"),
        F.sum("storage_bytes_used").alias("storage_bytes"),
    )


def document_counters(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counters of every knowledge base recomputed from the facts."""
    docs = documents.groupBy("kb_id").agg(
        F.count_if(F.col("status") == "completed").alias("document_count"), F.sum("size_bytes").alias("storage_bytes_used"))
    parts = chunks.groupBy("kb_id").agg(F.count("*").alias("total_chunk_count"))
    return docs.join(parts, "kb_id", "left").withColumn(
        "total_chunk_count", F.coalesce("total_chunk_count", F.lit(0).cast("long")))


def counter_drift(stored: DataFrame, actual: DataFrame, counters: list[str], key: str = "kb_id") -> DataFrame:
    """Stored minus recomputed counters, for rows that disagree."""
    fresh = actual.select(key, *[F.col(c).alias(f"actual_{c}") for c in counters])
    gap = [(F.coalesce(c, F.lit(0)) - F.coalesce(f"actual_{c}", F.lit(0))).alias(f"drift_{c}") for c in counters]
    out = stored.select(key, *counters).join(fresh, key, "full_outer").select(key, *gap)
    wrong = F.lit(False)
    for c in counters:
        wrong = wrong | (F.col(f"drift_{c}") != 0)
    return out.filter(wrong)


def error_alarm(
    log: DataFrame,
    is_error: Column,
    ts: str = "ts",
    period_seconds: int = ALARM_PERIOD_SECONDS,
    threshold: int = ALARM_THRESHOLD,
    periods: int = ALARM_PERIODS,
    keys: list[str] | None = None,
) -> DataFrame:
    """Periods in which the error count exceeded the threshold ``periods`` times in a row.

    Each breaching period votes for itself and the following ones; an alarm is a
    period with all votes. A missing period casts none, so it is not breaching.
    There is no ordering over the log, only two aggregations.
    """
    keys = keys or []
    step = period_seconds * 1_000_000
    start = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / step) * step).cast("long")
    counts = log.filter(is_error).groupBy(*keys, start.alias("_p")).agg(F.count("*").alias("n_errors"))
    votes = counts.filter(F.col("n_errors") > threshold).select(
        *keys, "n_errors", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda i: F.col("_p") + i * step)).alias("_i", "_p")
    )
    return (
        votes.groupBy(*keys, "_p")
        .agg(F.count("*").alias("_votes"), F.max(F.when(F.col("_i") == 0, F.col("n_errors"))).alias("n_errors"))
        .filter(F.col("_votes") == periods)
        .select(*keys, F.timestamp_micros("_p").alias("alarm_at"), "n_errors")
    )


def usage_rollup(usage: DataFrame, ts: str = "created_at") -> DataFrame:
    """Calls, errors, latency, tokens and cost per user, endpoint and day with subtotals.

    Our own use of the log's declared fields; of tokens and cost those that the log
    carries are summed. ``latency_p95`` is approximate. Level names the grouping: total,
    user, endpoint or day. Sums combine before the shuffle.
    """
    carried = [c for c in ("input_tokens", "output_tokens", "estimated_cost_usd") if c in usage.columns]
    day = usage.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
    return day.rollup("user_id", "endpoint", "day").agg(
        F.grouping_id().alias("_g"),
        F.count("*").alias("calls"),
        F.count_if(F.col("status_code") >= ERROR_STATUS).alias("errors"),
        F.sum("latency_ms").alias("latency_ms"),
        F.percentile_approx("latency_ms", 0.95).alias("latency_p95"),
        *[F.sum(c).alias(c) for c in carried],
    ).withColumn("level", F.element_at(F.array(*map(F.lit, ["day", "endpoint", "?", "user", "?", "?", "?", "total"])), F.col("_g").cast("int") + 1)).drop("_g")


SKETCH_K = 1000  # the rank of a percentile is off by about 0.3 % at most


def usage_hours(usage: DataFrame, ts: str = "created_at", keys: tuple[str, ...] = ("user_id", "endpoint", "model"), k: int = SKETCH_K) -> DataFrame:
    """One row per hour and ``keys``: calls, errors, summed latency, and a quantile sketch of the latencies.

    Hours only ever grow by new rows, so a stored hour is never read again for its requests: any
    coarser report merges the rows of this table.
    """
    return usage.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status_code") >= ERROR_STATUS).alias("errors"), F.sum("latency_ms").alias("latency_ms"),
        F.count("latency_ms").alias("measured"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), k).alias("latencies"))


def usage_percentiles(hours: DataFrame, keys: list[str], quantile: float = 0.95) -> DataFrame:
    """Calls, errors, mean and a high percentile of the latency per ``keys``, from merged hours; no measured request, no percentile."""
    merged = hours.groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("latency_ms").alias("_sum"), F.sum("measured").alias("measured"),
        F.kll_merge_agg_double(F.when(F.col("measured") > 0, F.col("latencies"))).alias("_all"))
    high = F.when(F.col("measured") > 0, F.kll_sketch_get_quantile_double("_all", F.lit(quantile)))
    return merged.select(*keys, "calls", "errors", (F.col("_sum") / F.col("measured")).alias("latency_mean"), high.alias("latency_high"))


def rate_limit_aligned(requests: DataFrame, keys: list[str], limit: int, window_seconds: int = 60, ts: str = "ts") -> DataFrame:
    """Clock-aligned windows with more than ``limit`` requests."""
    return (
        requests.groupBy(*keys, F.window(ts, f"{window_seconds} seconds").alias("_w"))
        .agg(F.count("*").alias("n_requests"))
        .filter(F.col("n_requests") > limit)
        .select(*keys, F.col("_w.start").alias("window_start"), "n_requests")
    )
