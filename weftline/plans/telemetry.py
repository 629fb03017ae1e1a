"""Telemetry queries over ``events`` in the role of a log of tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import streaming
from weftline.operators.telemetry import lsp_stats, nearest_ranks, prune_candidates, recent_errors, retained, unused_tools, usage_stats
from weftline.plans import query
from weftline.staging import table

CALLS_SQL = """(SELECT event_type AS tool_name, ts AS called_at, value AS latency_ms, user_id AS session_id,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'recoverable_error' ELSE 'success' END AS outcome,
  CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS overflowed, event_id AS id, props FROM events)"""


def calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tool_name"), F.col("ts").alias("called_at"), F.col("value").alias("latency_ms"), F.col("user_id").alias("session_id"),
        F.expr("CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'recoverable_error' ELSE 'success' END").alias("outcome"),
        F.expr("CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END").alias("overflowed"), F.col("event_id").alias("id"), "props",
    )


@query(
    "usage_stats_7d",
    f"""SELECT tool_name, count(*) AS calls, count(*) FILTER (outcome IN ('error','recoverable_error')) AS errors,
  CAST(sum(overflowed) AS BIGINT) AS overflows, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.99) AS p99,
  round(count(*) FILTER (outcome IN ('error','recoverable_error')) * 100.0 / count(*), 4) AS error_rate_pct,
  round(sum(overflowed) * 100.0 / count(*), 4) AS overflow_rate_pct
FROM {CALLS_SQL} c WHERE called_at >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY tool_name""",
)
def usage_stats_7d(spark, sf_dir):
    return usage_stats(calls(spark, sf_dir), "7d")


STARTS_SQL = """(SELECT event_type AS language, CASE WHEN event_id % 19 = 0 THEN 'crash' ELSE 'open' END AS reason, CASE WHEN event_id % 8 = 0 THEN 'error' ELSE 'success' END AS outcome,
  CAST(floor(value * 10) AS BIGINT) AS handshake_ms, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS first_response_ms FROM events)"""


@query(
    "lsp_style_conditional_stats",
    f"""SELECT language, count(*) AS starts, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'error') AS failures, count(*) FILTER (reason = 'crash') AS crashes,
  CAST(round(avg(handshake_ms) FILTER (outcome = 'success')) AS BIGINT) AS mean_handshake, quantile_disc(first_response_ms, 0.95) FILTER (outcome = 'success' AND first_response_ms IS NOT NULL) AS p95_first FROM {STARTS_SQL} GROUP BY language""",
)
def lsp_style_conditional_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("language"), F.expr("if(event_id % 19 = 0, 'crash', 'open')").alias("reason"), F.expr("if(event_id % 8 = 0, 'error', 'success')").alias("outcome"), F.floor(F.col("value") * 10).alias("handshake_ms"), F.expr("if(event_id % 7 = 0, null, value)").alias("first_response_ms"))
    return lsp_stats(e)


@query("recent_errors", f"SELECT id, tool_name, called_at FROM {CALLS_SQL} WHERE outcome IN ('error','recoverable_error') ORDER BY called_at DESC, id DESC LIMIT 20")
def recent_errors_query(spark, sf_dir):
    return recent_errors(calls(spark, sf_dir)).select("id", "tool_name", "called_at")


@query("unused_tools", "SELECT DISTINCT c_mktsegment AS tool_name FROM customer UNION ALL SELECT 'never' ORDER BY 1")
def unused_tools_query(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tool_name")).distinct().unionByName(spark.createDataFrame([("never",), ("click",)], "tool_name string"))
    return unused_tools(names, calls(spark, sf_dir))


@query("prune_candidates", f"SELECT tool_name, count(*) AS calls FROM (SELECT tool_name || '-' || CAST(session_id AS VARCHAR) AS tool_name FROM {CALLS_SQL}) GROUP BY tool_name HAVING count(*) < 12")
def prune_candidates_query(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("tool_name", F.concat_ws("-", "tool_name", F.col("session_id").cast("string")))
    return prune_candidates(c, 12)


@query("retention", "SELECT count(*) AS calls, min(event_id) AS first_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention(spark, sf_dir):
    return retained(calls(spark, sf_dir), 10).agg(F.count("*").alias("calls"), F.min("id").alias("first_id"))


@query("percentile_forms", "SELECT event_type AS tool_name, quantile_disc(value, 0.28) AS p28, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentile_forms(spark, sf_dir):
    return nearest_ranks(calls(spark, sf_dir), "tool_name", "latency_ms", {"p28": 28, "p95": 95})


@query("hourly_window_stream", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL")
def hourly_window_stream(spark, sf_dir):
    out = streaming.run_to_table(streaming.hourly(streaming.file_stream(spark, sf_dir, "events")), "hourly", mode="complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "calls", "errors")


@query(
    "session_windows",
    """SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS o FROM events)) GROUP BY user_id, s""",
)
def session_windows(spark, sf_dir):
    out = streaming.run_to_table(streaming.sessions(streaming.file_stream(spark, sf_dir, "events"), "4 hours"), "sessions", mode="complete")
    return out.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "events")


@query("stream_deduplicated", "SELECT user_id, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_deduplicated(spark, sf_dir):
    s = streaming.deduplicated(streaming.file_stream(spark, sf_dir, "events"), "event_id")
    return streaming.run_to_table(s.groupBy("user_id", "event_type").agg(F.count("*").alias("events")), "dedup", mode="complete")


@query("stream_incremental_fold", "SELECT user_id AS artifact_id, arg_max(event_type, (ts, event_id)) AS latest_kind, arg_max(event_id, (ts, event_id)) AS latest_id, count(*) AS events FROM events GROUP BY user_id")
def stream_incremental_fold(spark, sf_dir):
    out = streaming.run_to_table(streaming.incremental_fold(streaming.file_stream(spark, sf_dir, "events")), "fold", mode="update")
    return out.groupBy("artifact_id").agg(F.max_by(F.struct("latest_kind", "latest_id", "events"), "events").alias("r")).select("artifact_id", "r.*")


@query("stream_two_phase", "SELECT a.user_id, count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR GROUP BY a.user_id")
def stream_two_phase(spark, sf_dir):
    s = lambda: streaming.file_stream(spark, sf_dir, "events")
    pairs = streaming.two_phase(s().where("event_type = 'view'"), s().where("event_type = 'purchase'"), "user_id", "2 hours")
    return streaming.run_to_table(pairs, "two_phase", mode="append").groupBy("user_id").agg(F.count("*").alias("pairs"))


@query("stream_upsert", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    s = streaming.file_stream(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return streaming.upsert_each_batch(s, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("stream_retention", "SELECT user_id, count(*) AS events, min(event_id) AS first_id FROM events WHERE epoch_us(ts) // 1000 >= (SELECT max(epoch_us(ts) // 1000) FROM events) - 10 * 86400000 GROUP BY user_id")
def stream_retention(spark, sf_dir):
    s = streaming.stateful.retained(streaming.file_stream(spark, sf_dir, "events"), "user_id", "event_id", days=10)
    log = streaming.run_to_table(s, "retention")
    held = log.groupBy("key", "id").agg(F.bool_and("held").alias("held")).where("held")
    return held.groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("events"), F.min("id").alias("first_id"))


@query(
    "stream_answers",
    """WITH v AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS began FROM events WHERE event_type = 'view'), p AS (SELECT user_id, epoch_us(ts) // 1000 AS ended FROM events WHERE event_type = 'purchase')
SELECT v.user_id, event_id, began, min(ended) AS ended, count(ended) > 0 AS answered FROM v LEFT JOIN p ON v.user_id = p.user_id AND ended BETWEEN began AND began + 7200000 WHERE began + 7200000 < (SELECT max(epoch_us(ts) // 1000) FROM events WHERE event_type IN ('view', 'purchase')) GROUP BY ALL""",
)
def stream_answers(spark, sf_dir):
    kind = lambda k: F.col("event_type") == k
    s = streaming.stateful.two_phase(streaming.file_stream(spark, sf_dir, "events"), "user_id", "event_id", kind("view"), kind("purchase"), 2 * 3600 * 1000)
    return streaming.run_to_table(s, "answers").select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "began", "ended", "answered")


@query("stream_field_fold", "SELECT user_id AS artifact_id, event_type AS field, arg_max(props, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY ALL")
def stream_field_fold(spark, sf_dir):
    e = streaming.file_stream(spark, sf_dir, "events")
    s = streaming.stateful.fold_fields(e.select(F.col("user_id").alias("artifact_id"), F.col("event_type").alias("field"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), F.col("props").alias("value")))
    out = streaming.run_to_table(s, "field_fold", mode="update")
    return out.groupBy("artifact_id", "field").agg(F.max_by(F.struct("value", "id"), F.struct("at", "id")).alias("r")).select("artifact_id", "field", "r.*")
