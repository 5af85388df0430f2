"""Request-body operators over the three provider dialects (A1, A10, B1-B8,
B11, B12, B14-B17, C13, C15, C16, G1-G4).

Bodies are parsed once into a VARIANT column; every walker below is a
row-local expression over it (higher-order functions over
``array<variant>``), so nothing shuffles until a result is regrouped by
request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.memo import column_memo
from veilframe.functions.spans import let, running
from veilframe.operators import pii
from veilframe.operators.audit import approx_tokens

# Provider names, upstream base URLs, native paths of the
# generic route, forwarded header allow-list, telemetry attributes stripped
# from traces and logs, probe traffic excluded from tracing.
PROVIDERS = ("openai", "anthropic", "gemini")
UPSTREAM_BASE = {
    "openai": "https://api.openai.com",
    "anthropic": "https://api.anthropic.com",
    "gemini": "https://generativelanguage.googleapis.com",
}
GENERIC_NATIVE_PATH = {"openai": "/v1/chat/completions", "anthropic": "/v1/messages", "gemini": "/v1beta/models"}
FORWARDED_HEADERS = ("authorization", "x-api-key", "x-goog-api-key", "anthropic-version",
                     "anthropic-beta", "openai-organization", "openai-project")
STRIPPED_ATTRIBUTES = ("gen_ai.prompt", "gen_ai.completion", "http.request.body", "http.response.body")
PROBE_URL_PATTERN = "health/.*|metrics"
# Inbound header names of the credential and of the generic route.
KEY_HEADER = "X-Gateway-Key"
PROVIDER_HEADER = "X-Gateway-Provider"

FIELDS_TYPE = "array<struct<field_ord:int,role:string,content:variant,top:boolean>>"


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


# ---------------------------------------------------------------------------
# A1: parse
# ---------------------------------------------------------------------------
def read_requests(df: DataFrame, body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """A1: parse JSON bodies; an empty body is ``{}``; invalid JSON goes to
    the rejects side output with ``INVALID_JSON``.  Returns (ok, rejects)."""
    b = F.col(body_col)
    parsed = df.withColumn("v", F.try_parse_json(F.when(b.isNull() | (b == ""), F.lit("{}")).otherwise(b)))
    ok = parsed.where(F.col("v").isNotNull())
    rejects = parsed.where(F.col("v").isNull()).drop("v").withColumn("error", F.lit("INVALID_JSON"))
    return ok, rejects


# ---------------------------------------------------------------------------
# routing
# ---------------------------------------------------------------------------
def with_route(df: DataFrame, path_col: str = "path") -> DataFrame:
    """B1: ``/<provider>/rest`` -> (provider, ``/rest``); unknown prefix ->
    error ``UNKNOWN_PROVIDER_PATH``."""
    p = F.col(path_col)
    prov = F.regexp_extract(p, "^/(openai|anthropic|gemini)/", 1)
    known = prov != ""
    return (df.withColumn("provider", F.when(known, prov))
              .withColumn("upstream_path", F.when(known, p.substr(F.length(prov) + 2, F.length(p))))
              .withColumn("route_error", F.when(~known, F.lit("UNKNOWN_PROVIDER_PATH"))))


def with_model(df: DataFrame, v_col: str = "v", provider_col: str = "provider",
               path_col: str = "upstream_path") -> DataFrame:
    """Body ``model``; for Gemini without one, the first path segment with
    a ``:`` gives the text before it (and stops), else the last segment
    starting ``gemini-``; none -> ``MODEL_REQUIRED``."""
    body_model = F.try_variant_get(F.col(v_col), "$.model", "string")
    segs = F.split(F.coalesce(F.col(path_col), F.lit("")), "/", -1)
    colon = F.filter(segs, lambda s: F.instr(s, ":") > 0)
    gem = F.filter(segs, lambda s: s.startswith("gemini-"))
    from_path = F.when(F.size(colon) > 0, F.substring_index(F.element_at(colon, 1), ":", 1)).otherwise(
        F.try_element_at(gem, F.lit(-1)))
    is_str = F.coalesce(F.schema_of_variant(F.try_variant_get(F.col(v_col), "$.model", "variant")) == "STRING", F.lit(False))
    m = F.when(is_str & (body_model != ""), body_model).when(
        ~F.col(v_col).isNull() & (F.col(provider_col) == "gemini") & ~(is_str & (body_model != "")), from_path)
    ok = m.isNotNull() & (m != "")
    return df.withColumn("model", F.when(ok, m)).withColumn("model_error", F.when(~ok, F.lit("MODEL_REQUIRED")))


def _truthy(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(False))
             .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
             .when(t.startswith("DECIMAL") | t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"),
                   F.try_variant_get(v, "$", "double") != 0)
             .when(t == "STRING", F.try_variant_get(v, "$", "string") != "")
             .when(t.startswith("ARRAY"), F.json_array_length(F.to_json(v)) > 0)
             .when(t.startswith("OBJECT"), F.to_json(v) != "{}")
             .otherwise(F.lit(False)))


def with_stream_flag(df: DataFrame, v_col: str = "v", provider_col: str = "provider",
                     path_col: str = "upstream_path") -> DataFrame:
    """Gemini streams when the path says ``streamGenerateContent`` or
    ``stream`` is literally true; other providers on a truthy ``stream``."""
    s = F.try_variant_get(F.col(v_col), "$.stream", "variant")
    literally_true = F.coalesce((F.schema_of_variant(s) == "BOOLEAN") & F.try_variant_get(s, "$", "boolean"), F.lit(False))
    gem = F.coalesce(F.col(path_col).contains("streamGenerateContent"), F.lit(False)) | literally_true
    return df.withColumn("is_stream", F.when(F.col(provider_col) == "gemini", gem).otherwise(_truthy(s)))


def with_upstream_url(df: DataFrame) -> DataFrame:
    """Provider base URL + upstream path."""
    return df.withColumn("upstream_url", F.concat(_lit_map(UPSTREAM_BASE)[F.col("provider")], F.col("upstream_path")))


def with_request_id(df: DataFrame, header_col: Column, key: Column) -> DataFrame:
    """Inbound id if present and non-empty, else a fresh 32-hex id.  The
    fresh id is derived from the row key so re-runs are reproducible."""
    fresh = F.substring(F.sha2(key.cast("string"), 256), 1, 32)
    return df.withColumn("request_id", F.when(header_col.isNull() | (header_col == ""), fresh).otherwise(header_col))


def with_generic_route(df: DataFrame, provider_header: Column) -> DataFrame:
    """Provider from a header; missing -> ``PROVIDER_HEADER_REQUIRED``,
    unknown -> ``UNKNOWN_PROVIDER``, else the provider's native path."""
    known = provider_header.isin(*PROVIDERS)
    return (df.withColumn("generic_provider", F.when(known, provider_header))
              .withColumn("native_path", F.when(known, _lit_map(GENERIC_NATIVE_PATH)[provider_header]))
              .withColumn("generic_error", F.when(provider_header.isNull() | (provider_header == ""),
                                                  F.lit("PROVIDER_HEADER_REQUIRED"))
                          .when(~known, F.lit("UNKNOWN_PROVIDER"))))


def drop_probe_traffic(df: DataFrame, url_col: str = "path") -> DataFrame:
    """Health checks and metrics scrapes never reach trace analysis."""
    return df.where(~F.coalesce(F.col(url_col).rlike(PROBE_URL_PATTERN), F.lit(False)))


# ---------------------------------------------------------------------------
# Maps and lists
# ---------------------------------------------------------------------------
def filter_attributes(m: Column, keep=FORWARDED_HEADERS, force: dict | None = None) -> Column:
    """Lower-case keys, keep an allow-list, then force fixed entries. Of several
    spellings of one key the last one wins."""
    force = {"content-type": "application/json"} if force is None else force
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.filter(entries, lambda e: e["key"].isin(*keep) & ~e["key"].isin(*force.keys()) & e["value"].isNotNull())
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["key"] == e["key"]))
    return F.map_concat(F.map_from_entries(last), _lit_map(force))


def strip_attributes(m: Column, keys=STRIPPED_ATTRIBUTES) -> Column:
    """Delete payload-bearing attributes."""
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def map_string(m: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";")


def split_csv(x: Column) -> Column:
    """Comma list -> trimmed, non-empty items."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ",", -1), lambda s: F.trim(s)), lambda s: s != "")


# ---------------------------------------------------------------------------
# Dialect walkers
# ---------------------------------------------------------------------------
def _arr(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _field(ord_: Column, role: Column, content: Column, top: bool = False) -> Column:
    return F.struct(ord_.cast("int").alias("field_ord"), role.alias("role"), content.alias("content"), F.lit(top).alias("top"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


@column_memo
def prompt_fields(v: Column, provider: Column) -> Column:
    """array<struct<field_ord, role, content variant, top>> in walk order; ``top`` marks
    the system prompt that stands outside the messages."""
    msgs = _arr(v, "$.messages")

    def message(m, i):
        return _field(i, F.try_variant_get(m, "$.role", "string"), F.try_variant_get(m, "$.content", "variant"))

    system = F.try_variant_get(v, "$.system", "variant")
    anth = F.concat(
        F.when(system.isNull(), F.array().cast(FIELDS_TYPE)).otherwise(
            F.array(_field(F.lit(0), F.lit("system"), system, True))),
        F.transform(msgs, lambda m, i: message(m, i + 1)))
    contents = _arr(v, "$.contents")
    sys_parts = F.try_variant_get(v, "$.systemInstruction.parts", "variant")
    gem = F.concat(
        F.transform(contents, lambda c, i: _field(i, F.try_variant_get(c, "$.role", "string"),
                                                  F.try_variant_get(c, "$.parts", "variant"))),
        F.when(sys_parts.isNull(), F.array().cast(FIELDS_TYPE)).otherwise(
            F.array(_field(F.size(contents), F.lit("system"), sys_parts, True))))
    empty = F.array().cast(FIELDS_TYPE)
    return (F.when(provider == "openai", F.transform(msgs, message)).when(provider == "anthropic", anth)
             .when(provider == "gemini", gem).otherwise(empty))


@column_memo
def _parts_of(content: Column, provider: Column) -> Column:
    """A field's content as array<struct<part variant, whole>>: a string is one whole part (Gemini
    knows lists only), a list its elements, anything else (null, a number, an object) none."""
    none = F.array().cast("array<struct<part:variant,whole:boolean>>")
    whole = F.array(F.struct(content.alias("part"), F.lit(True).alias("whole")))
    return (F.when(_is_string(content) & (provider != "gemini"), whole)
             .when(_is_array(content), F.transform(_arr(content, "$"), lambda p: F.struct(p.alias("part"), F.lit(False).alias("whole"))))
             .otherwise(none))


@column_memo
def _classify(part: Column, whole: Column, provider: Column, top: Column) -> Column:
    """struct<kind, text> by the rules of each dialect: a whole string is text; a list element is text
    if its type says so (OpenAI, Anthropic) or if it holds a string under ``text`` (Gemini); an Anthropic
    message may hold tool results with string content; all else is other (its canonical JSON, not
    scrubbed)."""
    kind_of = F.coalesce(F.try_variant_get(part, "$.type", "string"), F.lit(""))
    is_text = F.when(provider == "gemini", _is_string(F.try_variant_get(part, "$.text", "variant"))).otherwise(_is_object(part) & (kind_of == "text"))
    is_tool = (provider == "anthropic") & ~top & (kind_of == "tool_result") & _is_string(F.try_variant_get(part, "$.content", "variant"))
    kind = F.when(whole | is_text, F.lit("text")).when(is_tool, F.lit("tool_result")).otherwise(F.lit("other"))
    text = (F.when(whole, F.try_variant_get(part, "$", "string"))
             .when(is_text, F.coalesce(F.try_variant_get(part, "$.text", "string"), F.lit("")))
             .when(is_tool, F.try_variant_get(part, "$.content", "string"))
             .otherwise(F.to_json(part)))
    return F.struct(kind.alias("kind"), text.alias("text"))


@column_memo
def prompt_parts(v: Column, provider: Column) -> Column:
    """B2 inside a row: array<struct<field_ord, part_ord, role, kind, text>> in walk order."""
    return F.flatten(F.transform(prompt_fields(v, provider), lambda f: F.transform(
        _parts_of(f["content"], provider), lambda p, j: let(_classify(p["part"], p["whole"], provider, f["top"]), lambda c: F.struct(
            f["field_ord"].alias("field_ord"), j.cast("int").alias("part_ord"), f["role"].alias("role"),
            c["kind"].alias("kind"), c["text"].alias("text"))))))


def explode_prompt_parts(df: DataFrame, id_col: str, v_col: str = "v", provider_col: str = "provider") -> DataFrame:
    """B2: the canonical long form ``prompt_parts(request id, provider,
    field_ord, part_ord, role, kind, text, scrubbable)``.  Generators only:
    row-local, no shuffle."""
    requests = df.select(id_col, F.col(provider_col).alias("provider"), F.col(v_col).alias("_v"))
    p = requests.select(id_col, "provider", F.explode(prompt_parts(F.col("_v"), F.col("provider"))).alias("p"))
    return p.select(id_col, "provider", "p.*", F.col("p.kind").isin("text", "tool_result").alias("scrubbable"))


def _said(x: Column) -> Column:
    """A JSON value as it stands in a prompt line: text as it is, ``None`` / ``True`` / ``False``,
    numbers and anything nested as canonical JSON."""
    kind = F.schema_of_variant(x)
    return (F.when(kind == "STRING", F.try_variant_get(x, "$", "string")).when(kind == "VOID", F.lit("None"))
             .when(kind == "BOOLEAN", F.initcap(F.to_json(x))).otherwise(F.to_json(x)))


@column_memo
def prompt_text(v: Column, provider: Column) -> Column:
    """The cache text: ``role: content`` lines joined by newlines; non-text
    parts as JSON; Anthropic system first unless it is empty; Gemini system instruction last,
    whole and as JSON; unknown provider -> the whole body as JSON.  A message without role or
    content has an empty one, an explicit null reads ``None``."""
    def line(role, body):
        return F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(body, F.lit("")))

    def role_of(m):
        return _said(F.try_variant_get(m, "$.role", "variant"))

    def message(m):
        content = F.try_variant_get(m, "$.content", "variant")
        typed = lambda p: _is_object(p) & F.coalesce(F.try_variant_get(p, "$.type", "string") == "text", F.lit(False))
        parts = F.transform(_arr(content, "$"), lambda p: line(role_of(m), F.when(
            typed(p), _said(F.try_variant_get(p, "$.text", "variant"))).otherwise(F.to_json(p))))
        return F.when(_is_array(content), parts).otherwise(F.array(line(role_of(m), _said(content))))

    def turn(c):
        def said(p):
            text = F.try_variant_get(p, "$.text", "variant")
            return line(role_of(c), F.when(text.isNull(), F.to_json(p)).otherwise(_said(text)))
        return F.transform(_arr(c, "$.parts"), said)

    def optional(name, lead, body):
        value = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(_truthy(value), F.array(F.concat(F.lit(lead), body(value)))).otherwise(F.array().cast("array<string>"))

    messages = F.flatten(F.transform(_arr(v, "$.messages"), message))
    tools = optional("tools", "tools:", F.to_json)
    lines = (F.when(provider == "openai", F.concat(messages, tools))
              .when(provider == "anthropic", F.concat(optional("system", "system: ", _said), messages, tools))
              .when(provider == "gemini", F.concat(F.flatten(F.transform(_arr(v, "$.contents"), turn)),
                                                   optional("systemInstruction", "system: ", F.to_json))))
    return F.when(provider.isin(*PROVIDERS), F.array_join(lines, "\n")).otherwise(F.to_json(v))


@column_memo
def response_text(v: Column, provider: Column) -> Column:
    """Assistant text of a response body, parts joined by newlines."""
    choices = _arr(v, "$.choices")
    def joined(content):  # a list of parts counts as its text parts, joined
        typed = F.filter(_arr(content, "$"), lambda p: F.coalesce(F.try_variant_get(p, "$.type", "string") == "text", F.lit(False)))
        texts = F.transform(typed, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
        return F.when(_is_string(content), F.try_variant_get(content, "$", "string")).when(_is_array(content), F.array_join(texts, "\n"))

    openai = F.filter(F.transform(choices, lambda c: joined(F.try_variant_get(c, "$.message.content", "variant"))),
                      lambda s: s.isNotNull())
    blocks = _arr(v, "$.content")
    anth = F.transform(F.filter(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "text", F.lit(False))),
                       lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    cands = _arr(v, "$.candidates")
    gem = F.filter(F.flatten(F.transform(cands, lambda c: F.transform(_arr(c, "$.content.parts"),
                                                                      lambda p: F.try_variant_get(p, "$.text", "string")))),
                   lambda s: s.isNotNull())
    arr = (F.when(provider == "openai", openai).when(provider == "anthropic", anth)
            .when(provider == "gemini", gem).otherwise(F.array().cast("array<string>")))
    return F.array_join(arr, "\n")


# ---------------------------------------------------------------------------
# Request-level scrub and restore
# ---------------------------------------------------------------------------
@column_memo
def _numbered_parts(parts: Column, mode: str) -> Column:
    """Parts (field_ord, part_ord, ..., text, spans) with the spans numbered over the whole
    request, in (field, part, start) order, and the text rebuilt."""
    def numbered(ps):
        ahead = running(ps, F.lit(0), lambda p: F.size(p["spans"]), lambda a, b: a + b, lambda p, before: before)
        whole = pii.with_placeholders(F.flatten(F.transform(ps, lambda p: p["spans"])), mode)
        return let(ahead, lambda at: let(whole, lambda sp: F.transform(ps, lambda p, i: let(
            F.slice(sp, F.get(at, i) + 1, F.size(p["spans"])), lambda mine: F.struct(
                p["field_ord"].alias("field_ord"), p["part_ord"].alias("part_ord"), p["role"].alias("role"), p["kind"].alias("kind"),
                pii.rebuild_text(p["text"], mine).alias("text"), mine.alias("spans"))))))

    return let(parts, numbered)


def scrub_requests(parts: DataFrame, id_col: str, mode: str = "reversible", **kw) -> DataFrame:
    """C13 over exploded parts (B2): scrub every scrubbable part (row-local), then number placeholders
    per *request* in (field, part, start) order, so a second message's
    address gets ``<EMAIL_ADDRESS_2>`` instead of overwriting the first
    (quirk Q1 fixed).  One shuffle: the regroup by request.  ``bodies.scrub_bodies`` does
    the same from whole bodies, without a shuffle, and rebuilds them.

    Returns one row per request with a part: ``parts`` (field_ord, part_ord, scrubbed
    text), ``spans`` (request-level placeholders), ``mapping``."""
    d = pii.detect_spans(parts.where(F.col("scrubbable")), "text", "spans", **kw)
    per_part = d.select(id_col, F.struct("field_ord", "part_ord", "role", "kind", "text", "spans").alias("p"))
    g = per_part.groupBy(id_col).agg(F.array_sort(F.collect_list("p")).alias("_parts"))
    return with_request_spans(pii.fenced(g, "parts", _numbered_parts(F.col("_parts"), mode)).drop("_parts"), mode)


@column_memo
def _request_spans(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda p: F.transform(p["spans"], lambda s: F.struct(
        p["field_ord"].alias("field_ord"), p["part_ord"].alias("part_ord"), s["span_start"].alias("span_start"),
        s["span_end"].alias("span_end"), s["entity"].alias("entity"), s["score"].alias("score"),
        s["value"].alias("value"), s["placeholder"].alias("placeholder")))))


def with_request_spans(df: DataFrame, mode: str) -> DataFrame:
    """Adds ``spans`` of all parts and ``mapping`` to numbered ``parts``."""
    out = pii.fenced(df, "spans", _request_spans(F.col("parts")))
    return out.withColumn("mapping", pii.placeholder_map(F.col("spans"), mode))


def reassemble_chunks(chunks: DataFrame, id_col: str, seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """A10: ordered chunks -> one text per request (restore happens after
    reassembly, so a placeholder split across chunks is still found: Q7)."""
    return chunks.groupBy(id_col).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(seq_col).alias("s"), F.col(chunk_col).alias("c")))),
        lambda x: x["c"]), "").alias("text"))


def count_tokens(text: Column, provider: Column, counters: dict | None = None) -> Column:
    """Provider-dispatched token count.  ``counters`` maps a provider to a
    function Column -> Column (for example a vectorised pandas UDF wrapping a
    real tokenizer); providers without one use the G1 approximation."""
    out = approx_tokens(text)
    for name, fn in (counters or {}).items():
        out = F.when(provider == name, fn(text)).otherwise(out)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(out)


def token_counts(prompt: Column, completion: Column, is_stream: Column, provider: Column | None = None,
                 counters: dict | None = None) -> tuple[Column, Column]:
    """Prompt and completion tokens; streamed responses count 0
    completion tokens (no body is read)."""
    prov = provider if provider is not None else F.lit(None).cast("string")
    return (count_tokens(prompt, prov, counters),
            F.when(is_stream, F.lit(0)).otherwise(count_tokens(completion, prov, counters)))


def request_hash(v: Column) -> Column:
    """SHA-256 of the canonical JSON of a (scrubbed) body."""
    return F.sha2(F.to_json(v), 256)
