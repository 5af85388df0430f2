"""Request-body queries over ``conversations``, ``events`` and ``pages``
(A1, A10, B1-B8, B12, B14-B17, C13, C15, C16, G1-G4).

The oracles never parse JSON: they derive the expected parts, lines and
routes straight from ``conversations`` with the same dialect rules the
bodies were built with, so a walker bug shows up as a mismatch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import bodies as BD
from veilframe.operators import cache as C
from veilframe.operators import pii
from veilframe.operators import prompt as P
from veilframe.plans.pii_sql import restore_sql, scrub_ctes
from veilframe.plans.registry import register
from veilframe.sources import bodies as B
from veilframe.sources.tables import load

IMAGE_JSON_SQL = "'{\"image_url\":{\"url\":\"https://img.example/' || CAST(conv_id AS VARCHAR) || '.png\"},\"type\":\"image_url\"}'"
TOOL_JSON_SQL = ("'{\"content\":\"done ' || CAST(conv_id AS VARCHAR) || '\",\"tool_use_id\":\"call_' || CAST(turn AS VARCHAR) "
                 "|| '\",\"type\":\"tool_result\"}'")

UNTYPED_SQL = "'{\"text\":\"untyped ' || CAST(conv_id AS VARCHAR) || '\"}'"

CONV_SQL = f"""conv AS (
  SELECT conv_id, turn, role, {B.AUGMENTED_TEXT_SQL} AS text, conv_id % 3 AS d,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos_all,
         row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) - 1 AS pos_grp,
         count(*) FILTER (WHERE role <> 'system') OVER (PARTITION BY conv_id) AS n_chat,
         count(*) OVER (PARTITION BY conv_id) AS n_all
  FROM conversations),
odd AS (SELECT DISTINCT conv_id, d, n_all, n_chat, n_all > n_chat AS has_system FROM conv WHERE {B.ODD_SQL}),
parts AS (
  SELECT conv_id, turn, pos_all AS field_ord, 0 AS part_ord, role, 'text' AS kind, text FROM conv WHERE d = 0
  UNION ALL
  SELECT conv_id, turn, pos_all, 1, role, 'other', {IMAGE_JSON_SQL} FROM conv WHERE d = 0 AND turn % 4 = 1
  UNION ALL
  SELECT conv_id, turn, 0, 0, 'system', 'text', text FROM conv WHERE d = 1 AND role = 'system'
  UNION ALL
  SELECT conv_id, turn, pos_grp + 1, 0, role, 'text', text FROM conv WHERE d = 1 AND role <> 'system'
  UNION ALL
  SELECT conv_id, turn, pos_grp + 1, 1, role, 'tool_result', 'done ' || CAST(conv_id AS VARCHAR) FROM conv
  WHERE d = 1 AND role <> 'system' AND turn % 4 = 3
  UNION ALL
  SELECT conv_id, turn, pos_grp, 0, CASE WHEN role = 'assistant' THEN 'model' ELSE role END, 'text', text
  FROM conv WHERE d = 2 AND role <> 'system'
  UNION ALL
  SELECT conv_id, turn, n_chat, 0, 'system', 'text', text FROM conv WHERE d = 2 AND role = 'system'
  UNION ALL
  SELECT conv_id, NULL, n_all + 2, 0, 'user', 'other', {UNTYPED_SQL} FROM odd WHERE d = 0
  UNION ALL
  SELECT conv_id, NULL, 0, 0, 'system', 'text', '' FROM odd WHERE d = 1 AND NOT has_system),
lines AS (
  SELECT conv_id, field_ord, part_ord,
         CASE WHEN kind = 'tool_result' THEN role || ': ' || {TOOL_JSON_SQL} ELSE role || ': ' || text END AS line
  FROM parts WHERE NOT (conv_id % 3 = 2 AND role = 'system') AND NOT (conv_id % 3 = 1 AND role = 'system' AND text = '')
  UNION ALL
  SELECT conv_id, n_all, 0, 'assistant: None' FROM odd WHERE d = 0
  UNION ALL
  SELECT conv_id, n_all + 1, 0, 'user: ' FROM odd WHERE d = 0
  UNION ALL
  SELECT conv_id, n_chat, 0, 'system: "stay brief"' FROM odd WHERE d = 2 AND NOT has_system
  UNION ALL
  SELECT conv_id, n_chat, 0, 'system: {{"parts":[{{"text":' || to_json(text)::VARCHAR || '}}]}}'
  FROM conv WHERE d = 2 AND role = 'system'),
routed AS (SELECT DISTINCT conv_id, d FROM conv WHERE conv_id % 13 <> 0)"""


def _bodies(spark, sf):
    b = B.request_bodies(spark, sf)
    ok, _ = P.read_requests(b, "body")
    return P.with_route(ok, "path")


def _parts(spark, sf):
    r = _bodies(spark, sf).where(F.col("provider").isNotNull())
    return P.explode_prompt_parts(r, "conv_id", "v", "provider")


def _sql(body: str) -> str:
    return f"WITH {CONV_SQL}\n{body}"


@register("prompt_parts", operators=("B2",), oracle=_sql("""
SELECT conv_id, field_ord::INTEGER AS field_ord, part_ord::INTEGER AS part_ord, role, kind, text,
       kind IN ('text', 'tool_result') AS scrubbable
FROM parts WHERE conv_id % 13 <> 0"""))
def q_prompt_parts(spark, sf):
    return _parts(spark, sf).drop("provider")


@register("prompt_text", operators=("B3",), oracle=_sql("""
SELECT conv_id, string_agg(line, chr(10) ORDER BY field_ord, part_ord) AS prompt_text
FROM lines WHERE conv_id % 13 <> 0 GROUP BY conv_id"""))
def q_prompt_text(spark, sf):
    r = _bodies(spark, sf).where(F.col("provider").isNotNull())
    return r.select("conv_id", P.prompt_text(F.col("v"), F.col("provider")).alias("prompt_text"))


def _responses(spark, sf):
    b = B.request_bodies(spark, sf)
    resp = B.responses(b)
    return resp.select("conv_id", F.col("dialect").alias("provider"), F.parse_json("response").alias("rv"))


RESPONSE_TEXT_SQL = f"""CASE WHEN conv_id % 3 = 1 THEN {B.REPLY_SQL} || chr(10) || 'Done.' ELSE {B.REPLY_SQL} END"""


@register("response_text", operators=("B4",), oracle=f"""
SELECT DISTINCT conv_id, {RESPONSE_TEXT_SQL} AS response_text FROM conversations""")
def q_response_text(spark, sf):
    r = _responses(spark, sf)
    return r.select("conv_id", P.response_text(F.col("rv"), F.col("provider")).alias("response_text"))


@register("routes", operators=("B1",), oracle="""
SELECT DISTINCT conv_id,
  CASE WHEN conv_id % 13 = 0 THEN NULL ELSE ['openai', 'anthropic', 'gemini'][conv_id % 3 + 1] END AS provider,
  CASE WHEN conv_id % 13 = 0 THEN NULL WHEN conv_id % 3 = 0 THEN '/v1/chat/completions'
       WHEN conv_id % 3 = 1 THEN '/v1/messages'
       ELSE '/v1beta/models/' || CASE WHEN conv_id % 17 = 0 THEN '' ELSE 'gemini-1.5-pro' END
            || CASE WHEN conv_id % 5 = 0 THEN ':streamGenerateContent' ELSE ':generateContent' END END AS upstream_path,
  CASE WHEN conv_id % 13 = 0 THEN 'UNKNOWN_PROVIDER_PATH' END AS route_error
FROM conversations""")
def q_routes(spark, sf):
    return _bodies(spark, sf).select("conv_id", "provider", "upstream_path", "route_error")


@register("models", operators=("B5",), oracle="""
SELECT DISTINCT conv_id,
  CASE WHEN conv_id % 3 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'gpt-4o' ELSE 'gpt-4o-mini' END
       WHEN conv_id % 3 = 1 THEN 'claude-3-5-sonnet-20241022'
       WHEN conv_id % 17 = 0 THEN NULL ELSE 'gemini-1.5-pro' END AS model,
  CASE WHEN conv_id % 3 = 2 AND conv_id % 17 = 0 THEN 'MODEL_REQUIRED' END AS model_error
FROM conversations WHERE conv_id % 13 <> 0""")
def q_models(spark, sf):
    r = P.with_model(_bodies(spark, sf).where(F.col("provider").isNotNull()))
    return r.select("conv_id", "model", "model_error")


@register("stream_flags", operators=("B6",), oracle="""
SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 1 THEN FALSE ELSE conv_id % 5 = 0 END AS is_stream
FROM conversations WHERE conv_id % 13 <> 0""")
def q_stream_flags(spark, sf):
    r = P.with_stream_flag(_bodies(spark, sf).where(F.col("provider").isNotNull()))
    return r.select("conv_id", "is_stream")


@register("upstream_urls", operators=("B12",), oracle="""
SELECT DISTINCT conv_id,
  CASE WHEN conv_id % 3 = 0 THEN 'https://api.openai.com/v1/chat/completions'
       WHEN conv_id % 3 = 1 THEN 'https://api.anthropic.com/v1/messages'
       ELSE 'https://generativelanguage.googleapis.com/v1beta/models/' || CASE WHEN conv_id % 17 = 0 THEN '' ELSE 'gemini-1.5-pro' END
            || CASE WHEN conv_id % 5 = 0 THEN ':streamGenerateContent' ELSE ':generateContent' END END AS upstream_url
FROM conversations WHERE conv_id % 13 <> 0""")
def q_upstream_urls(spark, sf):
    r = P.with_upstream_url(_bodies(spark, sf).where(F.col("provider").isNotNull()))
    return r.select("conv_id", "upstream_url")


@register("header_filter", operators=("B7",), oracle="""
SELECT DISTINCT conv_id, 'anthropic-version=2023-06-01;authorization=Bearer sk-fake-' || CAST(conv_id AS VARCHAR)
  || ';content-type=application/json;openai-organization=org-' || CAST(conv_id % 3 AS VARCHAR) AS forwarded
FROM conversations""")
def q_header_filter(spark, sf):
    b = B.request_bodies(spark, sf)
    return b.select("conv_id", P.map_string(P.filter_attributes(F.col("headers"))).alias("forwarded"))


@register("request_ids", operators=("B14",), oracle="""
SELECT DISTINCT conv_id, CASE WHEN conv_id % 4 IN (0, 1) THEN substr(sha256(CAST(conv_id AS VARCHAR)), 1, 32)
                              ELSE 'req-' || CAST(conv_id AS VARCHAR) END AS request_id
FROM conversations""")
def q_request_ids(spark, sf):
    b = B.request_bodies(spark, sf)
    r = P.with_request_id(b, F.try_element_at(F.col("headers"), F.lit("X-Request-Id")), F.col("conv_id"))
    return r.select("conv_id", "request_id")


@register("generic_routes", operators=("B15",), oracle="""
SELECT DISTINCT conv_id,
  CASE WHEN conv_id % 7 IN (0, 1) THEN NULL ELSE ['openai', 'anthropic', 'gemini'][conv_id % 3 + 1] END AS generic_provider,
  CASE WHEN conv_id % 7 IN (0, 1) THEN NULL ELSE ['/v1/chat/completions', '/v1/messages', '/v1beta/models'][conv_id % 3 + 1] END AS native_path,
  CASE WHEN conv_id % 7 = 0 THEN 'PROVIDER_HEADER_REQUIRED' WHEN conv_id % 7 = 1 THEN 'UNKNOWN_PROVIDER' END AS generic_error
FROM conversations""")
def q_generic_routes(spark, sf):
    b = B.request_bodies(spark, sf)
    r = P.with_generic_route(b, F.try_element_at(F.col("headers"), F.lit(P.PROVIDER_HEADER)))
    return r.select("conv_id", "generic_provider", "native_path", "generic_error")


PROBE_PATHS = ("/health/live", "/health/ready", "/metrics", "/openai/v1/chat/completions", "/api/v1/keys")


@register("probe_filter", operators=("B16",), oracle=f"""
SELECT event_id, {"[" + ", ".join(f"'{p}'" for p in PROBE_PATHS) + "]"}[event_id % 5 + 1] AS path FROM events
WHERE event_id % 5 NOT IN (0, 1, 2)""")
def q_probe_filter(spark, sf):
    e = load(spark, sf, "events").select("event_id")
    paths = F.element_at(F.array(*[F.lit(p) for p in PROBE_PATHS]), (F.col("event_id") % 5 + 1).cast("int"))
    return P.drop_probe_traffic(e.withColumn("path", paths), "path")


@register("attribute_strip", operators=("B8",), oracle="""
SELECT event_id, array_to_string(list_sort(CASE WHEN event_id % 3 = 2
  THEN ['gen_ai.prompt=' || props, 'http.request.body=' || props, event_type || '=' || CAST(value AS VARCHAR)]
  ELSE [event_type || '=' || CAST(value AS VARCHAR)] END), ';') AS attributes
FROM events""")
def q_attribute_strip(spark, sf):
    """Telemetry rows from events: traces (id % 3 = 0) and logs (1) lose the
    payload attributes, metrics (2) keep them."""
    e = load(spark, sf, "events")
    attrs = F.create_map(F.col("event_type"), F.col("value").cast("string"), F.lit("gen_ai.prompt"), F.col("props"),
                         F.lit("http.request.body"), F.col("props"))
    out = F.when(F.col("event_id") % 3 == 2, attrs).otherwise(P.strip_attributes(attrs))
    return e.select("event_id", P.map_string(out).alias("attributes"))


@register("csv_split", operators=("B17",), oracle="""
SELECT page_id, list_filter(list_transform(string_split(' ' || url || ' ,, ' || CAST(page_id AS VARCHAR) || ' , ', ','),
                                           lambda s: trim(s)), lambda s: s <> '') AS items
FROM pages""")
def q_csv_split(spark, sf):
    p = load(spark, sf, "pages")
    csv = F.concat(F.lit(" "), F.col("url"), F.lit(" ,, "), F.col("page_id").cast("string"), F.lit(" , "))
    return p.select("page_id", P.split_csv(csv).alias("items"))


def _raw_bodies(e):
    props = F.col("props")
    return e.select("event_id", F.when(F.col("event_id") % 50 == 0, props.substr(1, 5))
                    .when(F.col("event_id") % 77 == 0, F.lit("")).otherwise(props).alias("body"))


@register("json_rejects", operators=("A1",), oracle="""
SELECT event_id, CASE WHEN json_valid(b) THEN 'ok' ELSE 'INVALID_JSON' END AS status,
       CASE WHEN json_valid(b) THEN CAST(json_extract(b, '$.k') AS BIGINT) END AS k
FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN substr(props, 1, 5) WHEN event_id % 77 = 0 THEN '{}'
                            ELSE props END AS b FROM events)""")
def q_json_rejects(spark, sf):
    ok, rej = P.read_requests(_raw_bodies(load(spark, sf, "events")), "body")
    good = ok.select("event_id", F.lit("ok").alias("status"), F.try_variant_get("v", "$.k", "bigint").alias("k"))
    bad = rej.select("event_id", F.col("error").alias("status"), F.lit(None).cast("bigint").alias("k"))
    return good.unionByName(bad)


@register("token_usage", operators=("G1", "G2", "G3"), oracle=_sql(f"""
, pt AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY field_ord, part_ord) AS t FROM lines GROUP BY conv_id)
SELECT conv_id, CASE WHEN t = '' THEN 0 ELSE greatest(1, ceil(length(t) / 4)) END::INTEGER AS prompt_tokens,
       CASE WHEN (conv_id % 3 <> 1 AND conv_id % 5 = 0) THEN 0
            ELSE greatest(1, ceil(length({RESPONSE_TEXT_SQL}) / 4)) END::INTEGER AS completion_tokens
FROM pt WHERE conv_id % 13 <> 0"""))
def q_token_usage(spark, sf):
    r = P.with_stream_flag(_bodies(spark, sf).where(F.col("provider").isNotNull()))
    resp = _responses(spark, sf).select("conv_id", P.response_text(F.col("rv"), F.col("provider")).alias("rt"))
    j = r.select("conv_id", "is_stream", P.prompt_text(F.col("v"), F.col("provider")).alias("pt")).join(resp, "conv_id")
    ptok, ctok = P.token_counts(F.col("pt"), F.col("rt"), F.col("is_stream"))
    return j.select("conv_id", ptok.alias("prompt_tokens"), ctok.alias("completion_tokens"))


# --- request-level scrub ---------------------------------------------------
SCRUB_SRC = ("SELECT conv_id * 1000 + field_ord * 10 + part_ord AS rid, text FROM parts "
             "WHERE kind IN ('text', 'tool_result') AND conv_id % 13 <> 0")


def _request_scrub_sql(body: str) -> str:
    inner = scrub_ctes(SCRUB_SRC).replace("WITH src AS", f"WITH {CONV_SQL},\nsrc AS", 1)
    return inner + f""",
req AS (SELECT rid // 1000 AS conv_id, rid % 1000 AS pk, entity, s, e, v FROM kept),
reqph AS (SELECT *, '<' || entity || '_' || CAST(row_number() OVER (PARTITION BY conv_id, entity ORDER BY pk, s) AS VARCHAR)
                   || '>' AS placeholder FROM req),
convs AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 13 <> 0)
{body}"""


def _scrubbed(spark, sf):
    """Every routed request with its scrubbed body, spans and mapping."""
    return BD.scrub_bodies(_bodies(spark, sf).where(F.col("provider").isNotNull()))


@register("scrub_requests", operators=("C13",), oracle=_request_scrub_sql("""
, hdr AS (SELECT conv_id, string_agg(entity || ':' || CAST(n AS VARCHAR), ',' ORDER BY entity) AS pii_header
         FROM (SELECT conv_id, entity, count(*) AS n FROM reqph GROUP BY ALL) GROUP BY conv_id),
maps AS (SELECT conv_id, count(*) AS n_entities,
                string_agg(placeholder || '=' || v, chr(1) ORDER BY placeholder || '=' || v) AS mapping_text
         FROM reqph GROUP BY conv_id)
SELECT c.conv_id, coalesce(m.n_entities, 0)::BIGINT AS n_entities, coalesce(h.pii_header, '') AS pii_header,
       coalesce(m.mapping_text, '') AS mapping_text
FROM convs c LEFT JOIN maps m USING (conv_id) LEFT JOIN hdr h USING (conv_id)"""))
def q_scrub_requests(spark, sf):
    s = _scrubbed(spark, sf)
    return s.select("conv_id", F.size("spans").cast("long").alias("n_entities"),
                    pii.pii_header(F.col("spans")).alias("pii_header"),
                    pii.mapping_string(F.col("mapping")).alias("mapping_text"))


# scrubbed text of every part, with request-level placeholders
SCRUBBED_PARTS_SQL = """,
cuts AS (SELECT conv_id, pk, s, e, placeholder, coalesce(lag(e) OVER (PARTITION BY conv_id, pk ORDER BY s), 0) AS after FROM reqph),
bits AS (SELECT c.conv_id, c.pk, string_agg(substr(t.text, c.after + 1, c.s - c.after) || c.placeholder, '' ORDER BY c.s) AS body, max(c.e) AS last_e
         FROM cuts c JOIN src t ON t.rid = c.conv_id * 1000 + c.pk GROUP BY ALL),
clean AS (SELECT p.conv_id, p.turn, p.field_ord, p.part_ord, p.role, p.kind,
                 CASE WHEN b.pk IS NULL THEN p.text ELSE b.body || substr(p.text, b.last_e + 1) END AS text
          FROM parts p LEFT JOIN bits b ON b.conv_id = p.conv_id AND b.pk = p.field_ord * 10 + p.part_ord WHERE p.conv_id % 13 <> 0)"""
_TEXT_PART = "'{\"text\":' || to_json(text)::VARCHAR || ',\"type\":\"text\"}'"
SCRUBBED_BODIES_SQL = SCRUBBED_PARTS_SQL + f""",
msgs AS (
  SELECT conv_id, field_ord, CASE
    WHEN conv_id % 3 = 2 THEN '{{"parts":[{{"text":' || to_json(text)::VARCHAR || '}}],"role":"' || role || '"}}'
    WHEN turn % 2 = 0 THEN '{{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '"}}'
    ELSE '{{"content":[' || {_TEXT_PART} || CASE WHEN conv_id % 3 = 0 AND turn % 4 = 1 THEN ',' || {IMAGE_JSON_SQL}
         WHEN conv_id % 3 = 1 AND turn % 4 = 3 THEN ',' || {TOOL_JSON_SQL} ELSE '' END || '],"role":"' || role || '"}}' END AS m
  FROM clean WHERE part_ord = 0 AND turn IS NOT NULL AND NOT (role = 'system' AND conv_id % 3 <> 0)
  UNION ALL
  SELECT conv_id, n_all, '{{"content":null,"role":"assistant"}},{{"role":"user"}},{{"content":[' || {UNTYPED_SQL} || '],"role":"user"}}'
  FROM odd WHERE d = 0 AND conv_id % 13 <> 0),
top AS (
  SELECT conv_id, text FROM clean WHERE role = 'system' AND conv_id % 3 <> 0),
lists AS (SELECT conv_id, '[' || string_agg(m, ',' ORDER BY field_ord) || ']' AS ms FROM msgs GROUP BY conv_id),
bodies AS (
  SELECT l.conv_id, CASE
    WHEN l.conv_id % 3 = 0 THEN '{{"messages":' || ms || ',"model":"' || CASE WHEN l.conv_id % 2 = 0 THEN 'gpt-4o' ELSE 'gpt-4o-mini' END
         || '","stream":' || CASE WHEN l.conv_id % 5 = 0 THEN 'true' ELSE 'false' END || '}}'
    WHEN l.conv_id % 3 = 1 THEN '{{"max_tokens":256,"messages":' || ms || ',"model":"claude-3-5-sonnet-20241022"'
         || coalesce(',"system":' || to_json(top.text)::VARCHAR, '') || '}}'
    ELSE '{{"contents":' || ms || coalesce(',"systemInstruction":{{"parts":[{{"text":' || to_json(top.text)::VARCHAR || '}}]}}',
         CASE WHEN l.conv_id % 7 = 3 THEN ',"systemInstruction":"stay brief"' ELSE '' END) || '}}' END AS body
  FROM lists l LEFT JOIN top USING (conv_id))"""


@register("scrubbed_bodies", operators=("C13",), oracle=_request_scrub_sql(SCRUBBED_BODIES_SQL + "\nSELECT conv_id, body FROM bodies"))
def q_scrubbed_bodies(spark, sf):
    """The request bodies with every scrubbable string replaced in its place."""
    return _scrubbed(spark, sf).select("conv_id", "body")


@register("request_hashes", operators=("G4",),
          oracle=_request_scrub_sql(SCRUBBED_BODIES_SQL + "\nSELECT conv_id, sha256(body) AS request_hash FROM bodies"))
def q_request_hashes(spark, sf):
    """SHA-256 of the whole scrubbed body in canonical JSON."""
    return _scrubbed(spark, sf).select("conv_id", F.sha2("body", 256).alias("request_hash"))


SCRUBBED_LINES_SQL = SCRUBBED_PARTS_SQL + f""",
clean_lines AS (
  SELECT conv_id, field_ord, part_ord, CASE WHEN kind = 'tool_result' THEN role || ': ' || {TOOL_JSON_SQL} ELSE role || ': ' || text END AS line
  FROM clean WHERE NOT (conv_id % 3 = 2 AND role = 'system') AND NOT (conv_id % 3 = 1 AND role = 'system' AND text = '')
  UNION ALL
  SELECT conv_id, field_ord, 0, 'system: {{"parts":[{{"text":' || to_json(text)::VARCHAR || '}}]}}' FROM clean WHERE conv_id % 3 = 2 AND role = 'system'
  UNION ALL
  SELECT conv_id, n_all, 0, 'assistant: None' FROM odd WHERE d = 0 AND conv_id % 13 <> 0
  UNION ALL
  SELECT conv_id, n_all + 1, 0, 'user: ' FROM odd WHERE d = 0 AND conv_id % 13 <> 0
  UNION ALL
  SELECT conv_id, n_chat, 0, 'system: "stay brief"' FROM odd WHERE d = 2 AND NOT has_system AND conv_id % 13 <> 0),
keys AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY field_ord, part_ord) AS prompt FROM clean_lines GROUP BY conv_id)"""


def _prompt_of_scrubbed(spark, sf):
    s = _scrubbed(spark, sf).select("*", F.parse_json("body").alias("sv"))
    return s.withColumn("prompt", P.prompt_text(F.col("sv"), F.col("provider")))


@register("scrubbed_prompt_hashes", operators=("D1", "B3"),
          oracle=_request_scrub_sql(SCRUBBED_LINES_SQL + "\nSELECT conv_id, sha256(prompt) AS prompt_hash FROM keys"))
def q_scrubbed_prompt_hashes(spark, sf):
    """The cache key: SHA-256 of the prompt text of the scrubbed body."""
    return _prompt_of_scrubbed(spark, sf).select("conv_id", C.prompt_hash(F.col("prompt")).alias("prompt_hash"))


RESTORE_SQL_BODY = f"""
, maps AS (SELECT conv_id, map_from_entries(list({{'key': placeholder, 'value': v}})) AS m FROM reqph GROUP BY conv_id),
resp AS (SELECT c.conv_id, {RESPONSE_TEXT_SQL.replace('conv_id', 'c.conv_id')} AS t,
                coalesce(m.m, MAP {{}}::MAP(VARCHAR, VARCHAR)) AS m
         FROM convs c LEFT JOIN maps m USING (conv_id))
SELECT conv_id, {restore_sql('t', 'm')} AS restored_text FROM resp"""


def _restored(spark, sf, text_df):
    s = _scrubbed(spark, sf).select("conv_id", "mapping")
    return text_df.join(s, "conv_id", "left").select(
        "conv_id", pii.restore(F.col("t"), F.coalesce(F.col("mapping"), F.create_map().cast("map<string,string>")))
        .alias("restored_text"))


@register("restore_responses", operators=("C15", "D14"), oracle=_request_scrub_sql(RESTORE_SQL_BODY))
def q_restore_responses(spark, sf):
    routed = _bodies(spark, sf).where(F.col("provider").isNotNull()).select("conv_id")
    r = _responses(spark, sf).join(routed, "conv_id", "left_semi")
    return _restored(spark, sf, r.select("conv_id", P.response_text(F.col("rv"), F.col("provider")).alias("t")))


def _response_json(text: str) -> str:
    """The responses of ``sources.bodies`` in canonical JSON, with ``text`` as their text (an SQL expression)."""
    return f"""CASE WHEN conv_id % 3 = 0 THEN '{{"choices":[{{"finish_reason":"stop","index":0,"message":{{"content":' || to_json({text})::VARCHAR
  || ',"role":"assistant"}}}},{{"delta":{{"content":' || to_json({text})::VARCHAR || '}},"index":1,"message":' || CASE WHEN n_ent > 0 THEN '{{}}' ELSE 'null' END
  || '}}],"created":1700000000,"id":"chatcmpl-' || CAST(conv_id AS VARCHAR) || '","model":"gpt-4o","object":"chat.completion","usage":{{"completion_tokens":5,"prompt_tokens":10,"total_tokens":15}}}}'
  WHEN conv_id % 3 = 1 THEN '{{"content":[{{"text":' || to_json({text})::VARCHAR || ',"type":"text"}},{{"text":"Done.","type":"text"}}]}}'
  ELSE '{{"candidates":[{{"content":{{"parts":[{{"text":' || to_json({text})::VARCHAR || '}}]}}}}]}}' END"""


@register("restored_bodies", operators=("C15",), oracle=_request_scrub_sql(f"""
, maps AS (SELECT conv_id, map_from_entries(list({{'key': placeholder, 'value': v}})) AS m, count(*) AS n_ent FROM reqph GROUP BY conv_id),
resp AS (SELECT c.conv_id, {B.REPLY_SQL.replace('conv_id', 'c.conv_id')} AS t, coalesce(m.n_ent, 0) AS n_ent,
                coalesce(m.m, MAP {{}}::MAP(VARCHAR, VARCHAR)) AS m
         FROM convs c LEFT JOIN maps m USING (conv_id)),
back AS (SELECT conv_id, n_ent, {restore_sql('t', 'm')} AS t FROM resp)
SELECT conv_id, {_response_json('t')} AS body FROM back"""))
def q_restored_bodies(spark, sf):
    """Response bodies with the placeholders of their texts (and of a streamed delta) restored in place."""
    routed = _bodies(spark, sf).where(F.col("provider").isNotNull()).select("conv_id")
    r = _responses(spark, sf).join(routed, "conv_id", "left_semi")
    return BD.restore_bodies(r, _scrubbed(spark, sf), "conv_id", "rv").select("conv_id", F.col("restored").alias("body"))


CHUNK_CHARS = 7


@register("restore_chunked", operators=("A10", "C16"), oracle=_request_scrub_sql(RESTORE_SQL_BODY))
def q_restore_chunked(spark, sf):
    """The response text streamed as 7-character chunks (placeholders straddle
    chunk borders), reassembled per request, then restored."""
    routed = _bodies(spark, sf).where(F.col("provider").isNotNull()).select("conv_id")
    r = _responses(spark, sf).join(routed, "conv_id", "left_semi").select(
        "conv_id", P.response_text(F.col("rv"), F.col("provider")).alias("t"))
    n = F.ceil(F.length("t") / CHUNK_CHARS).cast("int")
    chunks = r.select("conv_id", "t", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("seq")).select(
        "conv_id", "seq", F.col("t").substr(F.col("seq") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("chunk"))
    whole = P.reassemble_chunks(chunks, "conv_id").withColumnRenamed("text", "t")
    return _restored(spark, sf, whole)
