"""Usage log, alarms, rate limits and status log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators import analytics, listing, maintenance
from lorewell.operators.ratelimit import anchored_windows
from lorewell.plans import query, views
from lorewell.plans.views import SQL_USAGE
from lorewell.session import table
from lorewell.sources.tables import usage_log_rows


@query(f"""WITH {SQL_USAGE} SELECT id, user_id, endpoint, status_code FROM (
  SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
    CASE WHEN endpoint = '/signup' THEN '/health/live' WHEN endpoint = '/view' AND id % 2 = 0 THEN '/docs' ELSE endpoint END AS endpoint, status_code FROM logs)
WHERE user_id IS NOT NULL AND endpoint NOT LIKE '/health%' AND endpoint NOT LIKE '/docs%'""")
def usage_log_sink(spark, sf_dir):
    """Log rows with some anonymous callers and some health and documentation paths."""
    path = (
        F.when(F.col("endpoint") == "/signup", "/health/live")
        .when((F.col("endpoint") == "/view") & (F.col("id") % 2 == 0), "/docs").otherwise(F.col("endpoint"))
    )
    requests = views.usage(spark, sf_dir).withColumns({
        "user_id": F.when(F.col("id") % 11 != 0, F.col("user_id")), "endpoint": path})
    return usage_log_rows(requests).select("id", "user_id", "endpoint", "status_code")


@query(f"""WITH {SQL_USAGE}, t AS (SELECT max(created_at) AS m FROM logs)
SELECT count(*) AS api_calls, count(*) FILTER (WHERE status_code >= 400) AS api_errors FROM logs, t WHERE created_at >= m - INTERVAL 24 HOUR""")
def trailing_24h(spark, sf_dir):
    return analytics.usage_window(views.usage(spark, sf_dir), views.last_event(spark, sf_dir))


@query(f"""WITH {SQL_USAGE} SELECT id, user_id, endpoint, status_code, created_at FROM logs WHERE status_code >= 400
ORDER BY created_at DESC, id LIMIT 100 OFFSET 100""")
def error_page(spark, sf_dir):
    """Second page of the error listing."""
    errors = listing.errors(views.usage(spark, sf_dir)).select("id", "user_id", "endpoint", "status_code", "created_at")
    return listing.newest(errors, "created_at", "id", limit=100, offset=100)


@query(f"WITH {SQL_USAGE} SELECT id, user_id, endpoint, status_code, created_at FROM logs ORDER BY created_at DESC, id LIMIT 100")
def usage_page(spark, sf_dir):
    usage = views.usage(spark, sf_dir).select("id", "user_id", "endpoint", "status_code", "created_at")
    return listing.newest(usage, "created_at", "id", limit=100)


@query(f"""WITH {SQL_USAGE} SELECT coalesce(user_id, -1) AS user_id, coalesce(endpoint, '') AS endpoint, coalesce(day, '') AS day, level,
  calls, errors, round(latency, 4) AS latency_ms, input_tokens, round(cost, 6) AS estimated_cost_usd FROM (
  SELECT user_id, endpoint, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (WHERE status_code >= 400) AS errors,
    sum(latency_ms) AS latency, CAST(sum(id % 500) AS BIGINT) AS input_tokens, sum((id % 500) * 0.000002) AS cost, CASE grouping(user_id, endpoint, strftime(created_at, '%Y-%m-%d')) WHEN 0 THEN 'day' WHEN 1 THEN 'endpoint' WHEN 3 THEN 'user' ELSE 'total' END AS level
  FROM logs GROUP BY ROLLUP (user_id, endpoint, strftime(created_at, '%Y-%m-%d')))""")
def usage_rollup(spark, sf_dir):
    tokens = F.col("id") % 500
    rolled = analytics.usage_rollup(views.usage(spark, sf_dir).withColumn("input_tokens", tokens).withColumn("estimated_cost_usd", tokens * 0.000002))
    return rolled.select(
        F.coalesce("user_id", F.lit(-1).cast("long")).alias("user_id"), F.coalesce("endpoint", F.lit("")).alias("endpoint"),
        F.coalesce("day", F.lit("")).alias("day"), "level", "calls", "errors", F.round("latency_ms", 4).alias("latency_ms"),
        "input_tokens", F.round("estimated_cost_usd", 6).alias("estimated_cost_usd"))


@query(f"""WITH {SQL_USAGE}, m AS (SELECT *, 'model-' || CAST(id % 3 AS VARCHAR) AS model FROM logs)
SELECT endpoint, model, count(*) AS calls, count(*) FILTER (WHERE status_code >= 400) AS errors, round(avg(latency_ms), 3) AS latency_mean, TRUE AS percentile_holds
FROM m GROUP BY endpoint, model""")
def usage_percentiles(spark, sf_dir):
    """Latency of each endpoint and model from merged hourly sketches; the 95th percentile is held against the log: its exact rank is within half a per cent."""
    log = views.usage(spark, sf_dir).withColumn("model", F.concat(F.lit("model-"), (F.col("id") % 3).cast("string")))
    rolled = analytics.usage_percentiles(analytics.usage_hours(log), ["endpoint", "model"])
    below = log.join(F.broadcast(rolled.select("endpoint", "model", "latency_high")), ["endpoint", "model"]).groupBy("endpoint", "model").agg(
        F.count_if(F.col("latency_ms") < F.col("latency_high")).alias("below"), F.count_if(F.col("latency_ms") <= F.col("latency_high")).alias("upto"), F.count("latency_ms").alias("n"))
    slack = 0.005 * F.col("n") + 1
    holds = (F.col("below") - slack <= 0.95 * F.col("n")) & (0.95 * F.col("n") <= F.col("upto") + slack)
    return rolled.join(below, ["endpoint", "model"]).select("endpoint", "model", "calls", "errors", F.round("latency_mean", 3).alias("latency_mean"), holds.alias("percentile_holds"))


def alarm_sql(period: int, threshold: int) -> str:
    return f"""WITH c AS (SELECT (epoch_us(ts) // {period}000000) AS p, count(*) AS n_errors FROM events WHERE event_type = 'error' GROUP BY 1),
b AS (SELECT * FROM c WHERE n_errors > {threshold})
SELECT make_timestamp(b.p * {period}000000) AS alarm_at, b.n_errors FROM b JOIN b AS a ON a.p = b.p - 1"""


@query(alarm_sql(300, 1))
def error_alarm(spark, sf_dir):
    """More than one error in each of two 5-minute periods in a row (the given log never reaches 20)."""
    alarms = analytics.error_alarm(table(spark, sf_dir, "events"), F.col("event_type") == "error", threshold=1)
    return alarms.select(F.to_timestamp_ntz(F.date_format("alarm_at", "yyyy-MM-dd HH:mm:ss")).alias("alarm_at"), "n_errors")


@query(alarm_sql(3600, 4))
def error_alarm_hourly(spark, sf_dir):
    alarms = analytics.error_alarm(table(spark, sf_dir, "events"), F.col("event_type") == "error", period_seconds=3600, threshold=4)
    return alarms.select(F.to_timestamp_ntz(F.date_format("alarm_at", "yyyy-MM-dd HH:mm:ss")).alias("alarm_at"), "n_errors")


@query("""SELECT event_type, window_start, n_requests FROM (
  SELECT event_type, make_timestamp(epoch_us(ts) // 60000000 * 60000000) AS window_start, count(*) AS n_requests FROM events GROUP BY ALL) WHERE n_requests > 1""")
def rate_limit_aligned(spark, sf_dir):
    """Clock minutes with more than one request of a kind."""
    return analytics.rate_limit_aligned(table(spark, sf_dir, "events"), ["event_type"], 1)


def _anchored_sql(key: str, window_ms: int, limit: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT {key}, epoch_us(ts) // 1000 AS ms FROM events),
chain AS (
  SELECT {key}, min(ms) AS ms FROM e GROUP BY {key}
  UNION ALL
  SELECT c.{key}, min(e.ms) FROM chain c JOIN e ON e.{key} = c.{key} AND e.ms >= c.ms + {window_ms} GROUP BY c.{key}, c.ms)
SELECT c.{key}, c.ms AS window_start_ms, count(*) AS n_requests, count(*) > {limit} AS breach
FROM chain c JOIN e ON e.{key} = c.{key} AND e.ms >= c.ms AND e.ms < c.ms + {window_ms} GROUP BY ALL"""


@query(_anchored_sql("user_id", 6 * 3600 * 1000, 3))
def rate_limit_anchored(spark, sf_dir):
    """Six-hour windows that open with a user's first request, at most three requests each."""
    window = 6 * 3600 * 1000
    return anchored_windows(table(spark, sf_dir, "events"), "user_id", "ts", 3, window, 2 * window)


@query(_anchored_sql("event_type", 3600 * 1000, 5))
def rate_limit_hot_key(spark, sf_dir):
    """One-hour windows for keys that each hold a fifth of the log, cut into two-hour slices."""
    return anchored_windows(table(spark, sf_dir, "events"), "event_type", "ts", 5, 3600 * 1000, 2 * 3600 * 1000)


# Status log: the events of a user read as the changes of one document.
_STATES = {"signup": "pending", "view": "virus_scanning", "click": "extracting", "purchase": "chunking", "error": "failed"}


def _status_log(spark, sf_dir):
    status = F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv])[F.col("event_type")]
    progress = F.create_map(*[F.lit(x) for kv in maintenance.STATUS_PROGRESS.items() for x in kv])[status]
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"), progress.alias("progress"))


_SQL_STATUS = "changes AS (SELECT user_id AS doc_id, ts, event_id AS seq, CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " END AS status, CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {maintenance.STATUS_PROGRESS[v]}" for k, v in _STATES.items()) + " END AS progress FROM events)"


@query(f"""WITH {_SQL_STATUS} SELECT doc_id, arg_max(status, (ts, seq)) AS status, arg_max(progress, (ts, seq)) AS progress, max(ts) AS since,
  count(*) AS n_changes FROM changes GROUP BY doc_id""")
def status_latest(spark, sf_dir):
    return maintenance.latest_status(_status_log(spark, sf_dir))


@query(f"""WITH {_SQL_STATUS}, p AS (SELECT *, lag(status) OVER (PARTITION BY doc_id ORDER BY ts, seq) AS previous FROM changes)
SELECT doc_id, seq, coalesce(previous, '') AS previous, status FROM p WHERE NOT (
  (previous IS NULL AND status = 'pending') OR (coalesce(previous, '') || '>' || status) IN (
   'pending>virus_scanning', 'virus_scanning>extracting', 'extracting>chunking', 'pending>failed', 'virus_scanning>failed', 'extracting>failed', 'chunking>failed'))""")
def status_faults(spark, sf_dir):
    faults = maintenance.transition_faults(_status_log(spark, sf_dir))
    return faults.select("doc_id", "seq", F.coalesce("previous", F.lit("")).alias("previous"), "status")


@query(f"""WITH {_SQL_STATUS}, l AS (SELECT doc_id, arg_max(status, (ts, seq)) AS status, max(ts) AS since FROM changes GROUP BY doc_id)
SELECT doc_id, status, since FROM l WHERE status NOT IN ('completed', 'failed') AND since < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""")
def status_stuck(spark, sf_dir):
    latest = maintenance.latest_status(_status_log(spark, sf_dir))
    return maintenance.stuck_documents(latest, views.last_event(spark, sf_dir), 12).select("doc_id", "status", "since")
