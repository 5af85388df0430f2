"""Audit, usage and metrics queries over orders / customer / nation / events
(G5-G16, M1-M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import audit as A
from veilframe.operators import metrics as M
from veilframe.plans.registry import register
from veilframe.sources import domain as D
from veilframe.sources.tables import load

TS_FMT = "yyyy-MM-dd HH:mm:ss"
TS_SQL = "%Y-%m-%d %H:%M:%S"

# Price per 1k tokens (prompt, completion) by model: our own illustrative
# table (the reference leaves pricing as a TODO and records 0.0).
PRICES = (
    ("openai", "gpt-4o", 0.0025, 0.01), ("openai", "gpt-4o-mini", 0.00015, 0.0006),
    ("openai", "gpt-4-turbo", 0.01, 0.03), ("anthropic", "claude-3-5-sonnet-20241022", 0.003, 0.015),
    ("anthropic", "claude-3-5-haiku-20241022", 0.0008, 0.004), ("anthropic", "claude-3-opus-20240229", 0.015, 0.075),
    ("gemini", "gemini-1.5-pro", 0.00125, 0.005), ("gemini", "gemini-1.5-flash", 0.000075, 0.0003),
)
PRICES_SQL = "(VALUES " + ", ".join(f"('{p}', '{m}', {a}::DOUBLE, {b}::DOUBLE)" for p, m, a, b in PRICES) + \
    ") AS p(provider, model, prompt_per_1k, completion_per_1k)"

AUDIT_SQL = f"""audit AS (
  SELECT r.request_id, r.org_id, r.api_key_id, r.request_hash, r.provider, r.model, r.prompt_tokens,
         r.completion_tokens,
         coalesce((r.prompt_tokens * p.prompt_per_1k + r.completion_tokens * p.completion_per_1k) / 1000, 0.0)
           AS estimated_cost_usd,
         r.latency_ms, r.cache_hit, r.pii_categories, r.pii_entity_count,
         CASE WHEN r.status >= 400 THEN 'upstream_' || CAST(r.status AS VARCHAR) END AS error_code,
         r.trace_id, r.created_at, r.status, r.is_stream
  FROM requests r LEFT JOIN {PRICES_SQL} ON p.provider = r.provider AND p.model = r.model)"""


def _audit_sql(body: str) -> str:
    return D.with_views("", "requests").rstrip() + ",\n" + AUDIT_SQL + "\n" + body


def _prices(spark):
    return spark.createDataFrame(list(PRICES), "provider string, model string, prompt_per_1k double, completion_per_1k double")


def audit_table(spark, sf):
    return A.build_audit(D.requests(spark, sf), _prices(spark), keep=("status", "is_stream"))


@register("audit_rows", operators=("G6", "G13", "A2"), oracle=_audit_sql("""
SELECT request_id, org_id, api_key_id, request_hash, provider, model, prompt_tokens, completion_tokens,
       estimated_cost_usd, latency_ms, cache_hit, array_to_string(pii_categories, ',') AS pii_categories,
       pii_entity_count, error_code, trace_id FROM audit"""))
def q_audit_rows(spark, sf):
    a = A.build_audit(D.requests(spark, sf), _prices(spark))
    return a.select("request_id", "org_id", "api_key_id", "request_hash", "provider", "model", "prompt_tokens",
                    "completion_tokens", "estimated_cost_usd", "latency_ms", "cache_hit",
                    F.array_join("pii_categories", ",").alias("pii_categories"), "pii_entity_count",
                    "error_code", "trace_id")


@register("error_codes", operators=("G5",), oracle=_audit_sql(
    "SELECT request_id, error_code FROM audit WHERE error_code IS NOT NULL"))
def q_error_codes(spark, sf):
    return A.with_error_code(D.requests(spark, sf)).where(F.col("error_code").isNotNull()).select(
        "request_id", "error_code")


ROLLUP_SQL_MEASURES = """count(*) AS requests, sum(prompt_tokens)::BIGINT AS prompt_tokens,
       sum(completion_tokens)::BIGINT AS completion_tokens, round(sum(estimated_cost_usd), 2) AS cost_usd,
       count(*) FILTER (WHERE cache_hit) AS cache_hits, count(*) FILTER (WHERE error_code IS NOT NULL) AS errors,
       sum(pii_entity_count)::BIGINT AS pii_entities"""


@register("usage_rollup", operators=("G9",), oracle=_audit_sql(f"""
SELECT org_id, provider, model, strftime(created_at, '%Y-%m') AS month, {ROLLUP_SQL_MEASURES}
FROM audit GROUP BY org_id, provider, model, strftime(created_at, '%Y-%m')"""))
def q_usage_rollup(spark, sf):
    a = audit_table(spark, sf).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    return a.groupBy("org_id", "provider", "model", "month").agg(*A.usage_measures())


@register("usage_cube", operators=("G9",), oracle=_audit_sql(f"""
SELECT provider, model, grouping(provider, model) AS gid, {ROLLUP_SQL_MEASURES}
FROM audit GROUP BY CUBE (provider, model)"""))
def q_usage_cube(spark, sf):
    a = audit_table(spark, sf)
    return a.cube("provider", "model").agg(F.grouping_id().alias("gid"), *A.usage_measures())


@register("org_timeline", operators=("G10",), oracle=_audit_sql(f"""
SELECT request_id, strftime(created_at, '{TS_SQL}') AS created_at, provider, model FROM audit
WHERE org_id = 7 AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1996-07-01'
ORDER BY created_at, request_id"""))
def q_org_timeline(spark, sf):
    t = A.org_timeline(audit_table(spark, sf), 7, "1996-01-01", "1996-07-01")
    return t.select("request_id", F.date_format("created_at", TS_FMT).alias("created_at"), "provider", "model")


TRACE_KEYS = ("7", "32", "1000", "12345")


@register("trace_lookup", operators=("G11",), oracle=_audit_sql(
    "SELECT request_id, trace_id, latency_ms FROM audit WHERE trace_id IN ("
    + ", ".join(f"substr(sha256('{k}'), 1, 32)" for k in TRACE_KEYS) + ")"))
def q_trace_lookup(spark, sf):
    wanted = [F.substring(F.sha2(F.lit(k), 256), 1, 32) for k in TRACE_KEYS]
    return audit_table(spark, sf).where(F.col("trace_id").isin(*wanted)).select("request_id", "trace_id", "latency_ms")


@register("cost", operators=("G13",), oracle=_audit_sql("""
SELECT provider, model, round(sum(estimated_cost_usd), 4) AS cost_usd, count(*) AS requests
FROM audit GROUP BY provider, model"""))
def q_cost(spark, sf):
    return audit_table(spark, sf).groupBy("provider", "model").agg(
        F.round(F.sum("estimated_cost_usd"), 4).alias("cost_usd"), F.count(F.lit(1)).alias("requests"))


@register("category_prevalence", operators=("G14",), oracle=_audit_sql("""
SELECT category, count(*) AS requests FROM (SELECT unnest(list_distinct(pii_categories)) AS category FROM audit)
GROUP BY category"""))
def q_category_prevalence(spark, sf):
    return A.category_prevalence(audit_table(spark, sf))


@register("repeat_requests", operators=("G12",), oracle=_audit_sql(
    "SELECT request_hash, count(*) AS n FROM audit GROUP BY request_hash HAVING count(*) > 1"))
def q_repeat_requests(spark, sf):
    return A.repeat_requests(audit_table(spark, sf))


@register("response_summary", operators=("G15",), oracle=_audit_sql("""
SELECT request_id, array_to_string(list_sort(pii_categories), ',') AS pii_categories,
       CASE WHEN cache_hit THEN 'true' ELSE 'false' END AS cache_hit_header, latency_ms AS latency_ms_header
FROM audit"""))
def q_response_summary(spark, sf):
    return A.response_summary(audit_table(spark, sf))


@register("trace_ids", operators=("G16",), oracle=_audit_sql("""
SELECT request_id,
  CASE WHEN request_id * 2654435761 % 4294967296 = 0 THEN NULL
       ELSE lpad(lower(hex(request_id * 2654435761 % 4294967296)), 32, '0') END AS trace_hex,
  CASE WHEN request_id % 7 = 0 THEN NULL ELSE lpad(lower(hex(request_id % 7)), 16, '0') END AS span_hex
FROM audit"""))
def q_trace_ids(spark, sf):
    a = audit_table(spark, sf)
    return a.select("request_id", A.hex_id(F.col("request_id") * 2654435761 % 4294967296, 32).alias("trace_hex"),
                    A.hex_id(F.col("request_id") % 7, 16).alias("span_hex"))


def _payload_rows(spark, sf):
    """Payload rows exist only for orgs that opted in and hold a key."""
    eligible = D.orgs(spark, sf).where(F.col("raw_logging_opt_in") & F.col("has_wrapped_key")).select("org_id")
    return audit_table(spark, sf).join(eligible, "org_id", "left_semi")


@register("sealed_optin_rows", operators=("G7", "A8"), oracle=_audit_sql("""
SELECT org_id, count(*) AS payload_rows FROM audit
WHERE org_id IN (SELECT org_id FROM (SELECT n_nationkey::BIGINT AS org_id FROM nation
                                     WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0))
GROUP BY org_id"""))
def q_sealed_optin_rows(spark, sf):
    return _payload_rows(spark, sf).groupBy("org_id").agg(F.count(F.lit(1)).alias("payload_rows"))


@register("retention_violations", operators=("G8",),
          oracle="SELECT 'x' AS violation, 'x' AS detail WHERE FALSE")
def q_retention_violations(spark, sf):
    return A.retention_violations(A.build_audit(D.requests(spark, sf)), _payload_rows(spark, sf), D.orgs(spark, sf))


# ---------------------------------------------------------------------------
# metrics
# ---------------------------------------------------------------------------
@register("request_counts", operators=("M1",), oracle=_audit_sql("""
SELECT provider, model, CASE WHEN is_stream THEN 'stream' ELSE CAST(status AS VARCHAR) END AS status, count(*) AS n
FROM audit GROUP BY ALL"""))
def q_request_counts(spark, sf):
    return M.request_counts(D.requests(spark, sf))


def _hist_sql():
    from veilframe.operators.metrics import LATENCY_BUCKETS
    arms = [f"SELECT provider, '{b}' AS le, count(*) FILTER (WHERE latency_ms / 1000.0 <= {b}) AS bucket_count, "
            f"sum(latency_ms / 1000.0) AS v_sum, count(*) AS v_count FROM audit GROUP BY provider"
            for b in LATENCY_BUCKETS]
    arms.append("SELECT provider, '+Inf', count(*), sum(latency_ms / 1000.0), count(*) FROM audit GROUP BY provider")
    return "SELECT provider, le, bucket_count, round(v_sum, 6) AS v_sum, v_count FROM (" + " UNION ALL ".join(arms) + ")"


@register("latency_histogram", operators=("M2",), oracle=_audit_sql(_hist_sql()))
def q_latency_histogram(spark, sf):
    r = D.requests(spark, sf).withColumn("latency_s", F.col("latency_ms") / 1000.0)
    h = M.latency_histogram(r, "latency_s", ["provider"])
    return h.withColumn("v_sum", F.round("v_sum", 6))


STAGES = {"pii_scrub": "s_scrub", "cache_lookup": "s_cache", "llm_forward": "s_forward", "total": "s_total"}


@register("stage_latency", operators=("M3",), oracle=_audit_sql("""
SELECT stage, count(*) AS n, round(sum(seconds), 6) AS seconds_sum FROM (
  SELECT 'pii_scrub' AS stage, latency_ms * 0.05 / 1000 AS seconds FROM audit
  UNION ALL SELECT 'cache_lookup', latency_ms * 0.1 / 1000 FROM audit WHERE NOT is_stream
  UNION ALL SELECT 'llm_forward', latency_ms * 0.8 / 1000 FROM audit WHERE NOT cache_hit
  UNION ALL SELECT 'total', latency_ms / 1000.0 FROM audit) GROUP BY stage"""))
def q_stage_latency(spark, sf):
    """Per-request stage durations (a fixed split of the total); cache lookup
    is not observed for streams, forwarding not for cache hits."""
    r = D.requests(spark, sf)
    lat = F.col("latency_ms")
    wide = r.select(
        (lat * 0.05 / 1000).alias("s_scrub"),
        F.when(~F.col("is_stream"), lat * 0.1 / 1000).alias("s_cache"),
        F.when(~F.col("cache_hit"), lat * 0.8 / 1000).alias("s_forward"),
        (lat / 1000.0).alias("s_total"))
    return M.stage_latency(wide, STAGES)


@register("latency_quantiles", operators=("M4",), oracle=_audit_sql("""
SELECT provider, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.9), 4) AS p90,
       round(quantile_cont(latency_ms, 0.99), 4) AS p99 FROM audit GROUP BY provider"""))
def q_latency_quantiles(spark, sf):
    return M.latency_quantiles(D.requests(spark, sf), "latency_ms", ["provider"])


@register("label_cardinality", operators=("M5",), oracle=_audit_sql("""
SELECT 'provider' AS label, count(DISTINCT provider) AS distinct_values FROM audit
UNION ALL SELECT 'model', count(DISTINCT model) FROM audit
UNION ALL SELECT 'status', count(DISTINCT status) FROM audit"""))
def q_label_cardinality(spark, sf):
    r = D.requests(spark, sf).withColumn("status", F.col("status").cast("long"))
    return M.label_cardinality(r.withColumn("provider", F.col("provider")), ["provider", "model", "status"]).select(
        "label", F.col("distinct_values").cast("long").alias("distinct_values"))


LOG_LEVEL_SQL = ("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'info' WHEN 'view' THEN 'DEBUG' "
                 "WHEN 'purchase' THEN 'WARNING' ELSE 'verbose' END")


def _logs(spark, sf):
    e = load(spark, sf, "events")
    level = (F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "info")
              .when(F.col("event_type") == "view", "DEBUG").when(F.col("event_type") == "purchase", "WARNING")
              .otherwise("verbose"))
    return e.select(F.col("event_id").alias("log_id"), F.col("event_id").alias("request_id"), level.alias("level"),
                    F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("log-"), F.col("event_id").cast("string"))).alias("trace_id"),
                    F.lit(None).cast("long").alias("org_id"))


@register("enriched_logs", operators=("M7",), oracle=D.with_views("""
SELECT e.event_id AS log_id, coalesce(CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE 'log-' || CAST(e.event_id AS VARCHAR) END,
                                      r.trace_id) AS trace_id, r.org_id AS org_id
FROM events e LEFT JOIN requests r ON r.request_id = e.event_id""", "requests"))
def q_enriched_logs(spark, sf):
    out = M.enrich_logs(_logs(spark, sf), D.requests(spark, sf))
    return out.select("log_id", "trace_id", "org_id")


@register("level_filter", operators=("M8",), oracle=f"""
SELECT event_id AS log_id, {LOG_LEVEL_SQL} AS level FROM events WHERE event_type IN ('error', 'purchase')""")
def q_level_filter(spark, sf):
    return M.filter_level(_logs(spark, sf), "warning").select("log_id", "level")
