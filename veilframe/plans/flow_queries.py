"""The whole request flow as one query (G6): authenticate, limit, scrub, hash, look up, count, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import audit as A
from veilframe.operators import bodies as BD
from veilframe.operators import cache as C
from veilframe.operators import keys as K
from veilframe.operators import pii
from veilframe.operators import prompt as P
from veilframe.operators import ratelimit as R
from veilframe.plans import prompt_queries as PQ
from veilframe.plans.history_queries import assign_hits
from veilframe.plans.registry import register
from veilframe.session import written
from veilframe.sources import bodies as B
from veilframe.sources import domain as D
from veilframe.sources.tables import load

N_KEYS = 20              # keys that send the conversations, one each minute
START = "1999-06-01 00:00:00"
TTL_MS = 86_400_000


def _attempts(spark, sf):
    """Every conversation is one request: conversation c is sent at START + c minutes with the key of customer
    c % 20 + 1; each nineteenth forgets the key."""
    conv = load(spark, sf, "conversations").select("conv_id").distinct()
    key = F.col("conv_id") % N_KEYS + 1
    return conv.select("conv_id", F.when(F.col("conv_id") % 19 != 0, D.token_of(key)).alias("presented"),
                       (F.lit(START).cast("timestamp_ntz") + F.expr("make_interval(0, 0, 0, 0, 0, cast(conv_id as int), 0)")).alias("ts"))


FLOW_SQL = f"""sent AS (SELECT DISTINCT conv_id, TIMESTAMP '{START}' + to_minutes(conv_id::INTEGER) AS ts FROM conversations),
ev AS (SELECT s.conv_id, k.key_id, k.org_id, epoch_ms(s.ts) AS t, CASE WHEN k.rate_limit_per_hour = 0 THEN {K.DEFAULT_RATE_LIMIT} ELSE k.rate_limit_per_hour END AS lim,
              row_number() OVER (PARTITION BY k.key_id ORDER BY s.ts, s.conv_id) AS rn
       FROM sent s JOIN ({D.API_KEYS_SQL}) k ON k.key_id = s.conv_id % {N_KEYS} + 1
       WHERE s.conv_id % 19 <> 0 AND (k.revoked_at IS NULL OR k.revoked_at > s.ts) AND (k.grace_expires_at IS NULL OR k.grace_expires_at > s.ts)),
run(key_id, rn, conv_id, adm, ok) AS (
  SELECT key_id, rn, conv_id, [t], lim > 0 FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.key_id, e.rn, e.conv_id,
         CASE WHEN len(list_filter(r.adm, lambda a: a > e.t - {R.WINDOW_MS})) < e.lim THEN list_append(list_filter(r.adm, lambda a: a > e.t - {R.WINDOW_MS}), e.t)
              ELSE list_filter(r.adm, lambda a: a > e.t - {R.WINDOW_MS}) END,
         len(list_filter(r.adm, lambda a: a > e.t - {R.WINDOW_MS})) < e.lim
  FROM run r JOIN ev e ON e.key_id = r.key_id AND e.rn = r.rn + 1),
hdr AS (SELECT conv_id, string_agg(DISTINCT entity, ',' ORDER BY entity) AS cats, count(*) AS n FROM reqph GROUP BY conv_id),
seen AS (
  SELECT e.conv_id, e.org_id, e.key_id, e.t, b.body, p.prompt, ['openai', 'anthropic', 'gemini'][e.conv_id % 3 + 1] AS provider,
         CASE WHEN e.conv_id % 3 = 0 THEN CASE WHEN e.conv_id % 2 = 0 THEN 'gpt-4o' ELSE 'gpt-4o-mini' END
              WHEN e.conv_id % 3 = 1 THEN 'claude-3-5-sonnet-20241022' ELSE 'gemini-1.5-pro' END AS model,
         e.conv_id % 3 <> 1 AND e.conv_id % 5 = 0 AS streams, CASE WHEN e.conv_id % 10 = 9 THEN 500 ELSE 200 END AS status
  FROM run JOIN ev e ON e.conv_id = run.conv_id JOIN bodies b ON b.conv_id = e.conv_id JOIN keys p ON p.conv_id = e.conv_id
  WHERE run.ok AND NOT (e.conv_id % 3 = 2 AND e.conv_id % 17 = 0)),
hits AS (SELECT a.conv_id, NOT a.streams AND EXISTS (SELECT 1 FROM seen b WHERE b.org_id = a.org_id AND b.provider = a.provider AND b.model = a.model
                AND b.prompt = a.prompt AND NOT b.streams AND b.status < 300 AND b.conv_id < a.conv_id AND b.t > a.t - {TTL_MS}) AS hit FROM seen a)
SELECT s.conv_id AS request_id, s.org_id, s.key_id AS api_key_id, sha256(s.body) AS request_hash, s.provider, s.model,
       greatest(1, ceil(length(s.prompt) / 4))::INTEGER AS prompt_tokens,
       CASE WHEN s.streams THEN 0 ELSE greatest(1, ceil(length({PQ.RESPONSE_TEXT_SQL.replace('conv_id', 's.conv_id')}) / 4)) END::INTEGER AS completion_tokens,
       h.hit AS cache_hit, coalesce(hdr.cats, '') AS pii_categories, coalesce(hdr.n, 0)::INTEGER AS pii_entity_count,
       CASE WHEN s.status >= 400 AND NOT h.hit THEN 'upstream_' || s.status END AS error_code
FROM seen s JOIN hits h USING (conv_id) LEFT JOIN hdr ON hdr.conv_id = s.conv_id"""


def _oracle() -> str:
    lines = PQ.SCRUBBED_LINES_SQL[len(PQ.SCRUBBED_PARTS_SQL):]
    return PQ._request_scrub_sql(PQ.SCRUBBED_BODIES_SQL + lines + ",\n" + FLOW_SQL).replace("WITH ", "WITH RECURSIVE ", 1)


def pipeline_audit(spark, sf):
    """Audit rows of the requests that got through, each stage fed by the one before."""
    # authenticate
    matched = K.auth_outcome(K.match_keys(_attempts(spark, sf), D.api_keys(spark, sf))).where(F.col("outcome") == "ok")
    limits = K.with_limit(D.api_keys(spark, sf)).select(F.col("key_id").alias("matched_key_id"), F.col("effective_limit").cast("int").alias("cap"))
    allowed = matched.join(limits, "matched_key_id").select(
        "conv_id", F.col("matched_key_id").alias("api_key_id"), F.col("matched_org_id").alias("org_id"), R.epoch_ms(F.col("ts")).alias("t"), "cap")
    # limit
    admitted = R.admit(allowed, "api_key_id", "t", "conv_id", "cap").where("admitted").select("conv_id", "api_key_id", "org_id", "t")
    # scrub: unknown providers and requests without a model are rejected before
    routed = PQ._bodies(spark, sf).where(F.col("provider").isNotNull()).join(admitted, "conv_id")
    asked = P.with_stream_flag(P.with_model(routed)).where(F.col("model").isNotNull())
    clean = BD.scrub_bodies(asked)
    prompts = pii.fenced(clean, "prompt", P.prompt_text(F.parse_json("body"), F.col("provider")))
    # written once, hashes and counts only: the cache history and the audit rows both read it
    keyed = written(prompts.select(
        "conv_id", "api_key_id", "org_id", "t", "provider", "model", "is_stream", F.sha2("body", 256).alias("request_hash"),
        C.prompt_hash(F.col("prompt")).alias("prompt_hash"), P.count_tokens(F.col("prompt"), F.col("provider")).alias("prompt_tokens"),
        pii.sorted_categories(F.col("spans")).alias("pii_categories"), F.size("spans").alias("pii_entity_count"),
        F.when(F.col("conv_id") % 10 == 9, 500).otherwise(200).alias("status")), "flow-requests")
    # look up: streams take no part
    history = keyed.where(~F.col("is_stream")).select(
        F.col("conv_id").alias("doc_id"), F.concat_ws(":", "org_id", "provider", "model", "prompt_hash").alias("cache_key"), "t", "status")
    hits = assign_hits(history, TTL_MS).select(F.col("doc_id").alias("conv_id"), F.col("hit").alias("cache_hit"))
    # forward, count, audit
    answers = B.responses(B.request_bodies(spark, sf)).select(
        "conv_id", P.response_text(F.parse_json("response"), F.col("dialect")).alias("answer"))
    done = keyed.join(hits, "conv_id", "left").join(answers, "conv_id", "left")
    _, completion_tokens = P.token_counts(F.lit(None), F.col("answer"), F.col("is_stream"))
    rows = done.select(
        F.col("conv_id").alias("request_id"), "org_id", "api_key_id", "request_hash", "provider", "model", "prompt_tokens",
        completion_tokens.alias("completion_tokens"), F.lit(None).cast("long").alias("latency_ms"), "cache_hit", "pii_categories", "pii_entity_count",
        F.lit(None).cast("string").alias("trace_id"), F.timestamp_millis("t").alias("created_at"),
        F.when(F.coalesce("cache_hit", F.lit(False)), 200).otherwise(F.col("status")).alias("status"))
    return A.build_audit(rows)


@register("pipeline_audit", operators=("G6", "B2", "B3", "D1", "E2", "F2"), oracle=_oracle())
def q_pipeline_audit(spark, sf):
    return pipeline_audit(spark, sf).select(
        "request_id", "org_id", "api_key_id", "request_hash", "provider", "model", "prompt_tokens", "completion_tokens", "cache_hit",
        F.array_join("pii_categories", ",").alias("pii_categories"), "pii_entity_count", "error_code")
