"""Rewriting provider bodies in place (C13, C15): scrubbed request bodies and restored responses.

A body is a VARIANT tree.  Spark reads variants but cannot change them, so a
rewritten body is written out as JSON: along the paths of a dialect (messages,
their contents, the parts, the strings) every level is taken apart into its
members and put together again, and whatever lies beside the paths is copied as
it is.  The result is the *canonical* JSON of the tree (members sorted by
name, no spaces, numbers as Spark writes them), which is what the request
hash is taken of.  All of it is row-local: no exchange, no UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.memo import column_memo
from veilframe.functions.spans import SPAN_ARRAY, let
from veilframe.operators import pii
from veilframe.operators import prompt as P

Change = Callable[[Column], Column]


def _json(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))


def quoted(s: Column) -> Column:
    """A string as JSON."""
    return F.to_json(s.cast("variant"))


def object_json(v: Column, changes: dict[str, Change], missing: dict[str, Column] | None = None) -> Column:
    """JSON of an object with the members named in ``changes`` rewritten (a change maps a member's
    value to JSON) and those of ``missing`` added where they are absent; other values as they are."""
    def member(e):
        value = _json(e["value"])
        for name, change in changes.items():
            value = F.when(e["key"] == name, change(e["value"])).otherwise(value)
        return F.struct(e["key"].alias("key"), value.alias("json"))

    def written(entries):
        members = F.transform(entries, member)
        for name, json in (missing or {}).items():
            absent = ~F.exists(entries, lambda e: e["key"] == name)  # noqa: B023
            members = F.when(absent, F.array_sort(F.concat(members, F.array(F.struct(F.lit(name).alias("key"), json.alias("json")))))).otherwise(members)
        return F.concat(F.lit("{"), F.array_join(F.transform(members, lambda m: F.concat(quoted(m["key"]), F.lit(":"), m["json"])), ","), F.lit("}"))

    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.when(P._is_object(v), let(entries, written)).otherwise(_json(v))


def array_json(v: Column, element: Callable[[Column, Column], Column]) -> Column:
    """JSON of an array with every element rewritten (``element(value, index)`` gives JSON)."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.when(P._is_array(v), F.concat(F.lit("["), F.array_join(F.transform(items, element), ","), F.lit("]"))).otherwise(_json(v))


@column_memo
def scrubbed_body(v: Column, provider: Column, texts: Column) -> Column:
    """A request body with its scrubbable strings replaced: ``texts[field][part]`` is the new
    text of a part in walk order (null leaves it).  OpenAI bodies always get a message list."""
    def text_at(field, part):
        return F.get(F.get(texts, field), part)

    def part_json(part, field, j):
        new = text_at(field, j)
        by_text = object_json(part, {"text": lambda _: quoted(new)}, {"text": quoted(new)})
        by_content = object_json(part, {"content": lambda _: quoted(new)})
        is_tool = F.coalesce(F.try_variant_get(part, "$.type", "string") == "tool_result", F.lit(False))
        return F.when(new.isNull(), _json(part)).when(is_tool & (provider == "anthropic"), by_content).otherwise(by_text)

    def content_json(content, field):
        whole = text_at(field, F.lit(0))
        return F.when(P._is_string(content) & whole.isNotNull(), quoted(whole)).otherwise(array_json(content, lambda p, j: part_json(p, field, j)))

    def messages_json(first):
        return lambda ms: array_json(ms, lambda m, i: object_json(m, {"content": lambda c: content_json(c, i + first)}))

    n_turns = F.size(P._arr(v, "$.contents"))
    openai = object_json(v, {"messages": lambda ms: F.when(P._is_array(ms), messages_json(0)(ms)).otherwise(F.lit("[]"))}, {"messages": F.lit("[]")})
    anthropic = object_json(v, {"system": lambda c: content_json(c, F.lit(0)), "messages": messages_json(1)})
    gemini = object_json(v, {
        "contents": lambda cs: array_json(cs, lambda c, i: object_json(c, {"parts": lambda ps: content_json(ps, i)})),
        "systemInstruction": lambda s: object_json(s, {"parts": lambda ps: content_json(ps, n_turns)})})
    return F.when(provider == "openai", openai).when(provider == "anthropic", anthropic).when(provider == "gemini", gemini).otherwise(_json(v))


def scrub_bodies(df: DataFrame, v_col: str = "v", provider_col: str = "provider", mode: str = "reversible",
                 recognizers=pii.DEFAULT_RECOGNIZERS, policy=None, threshold: float = pii.SCORE_THRESHOLD) -> DataFrame:
    """Scrub whole request bodies.  Every input row stays, also one without any text (an
    image only, no messages at all); nothing is exploded or shuffled.

    Adds ``parts`` (field_ord, part_ord, role, kind, text, spans), ``spans`` and ``mapping`` with
    request-level placeholders, and ``body``, the scrubbed body as canonical JSON."""
    provider = F.col(provider_col)
    found = pii.fenced(df, "_found", P.prompt_parts(F.col(v_col), provider))
    # candidates of all parts and their resolution are two generators: the regexes run once
    found = pii.fenced(found, "_cand", _part_candidates(F.col("_found"), recognizers, policy, threshold))
    kept = pii.fenced(found, "_kept", _part_spans(F.col("_found"), F.col("_cand"))).drop("_found", "_cand")
    spanned = P.with_request_spans(pii.fenced(kept, "parts", P._numbered_parts(F.col("_kept"), mode)).drop("_kept"), mode)
    texts = pii.fenced(spanned, "_texts", texts_by_field(F.col("parts")))
    return pii.fenced(texts, "body", scrubbed_body(F.col(v_col), provider, F.col("_texts"))).drop("_texts")


@column_memo
def _part_candidates(parts: Column, recognizers, policy, threshold) -> Column:
    return F.transform(parts, lambda p: F.when(p["kind"] != "other", pii.candidate_spans(p["text"], recognizers, policy, threshold)).otherwise(
        F.array().cast(SPAN_ARRAY)))


@column_memo
def _part_spans(parts: Column, candidates: Column) -> Column:
    return F.zip_with(parts, candidates, lambda p, c: F.struct(
        *[p[x].alias(x) for x in ("field_ord", "part_ord", "role", "kind", "text")], pii.resolve_overlaps(c).alias("spans")))


@column_memo
def texts_by_field(parts: Column) -> Column:
    """``texts[field][part]`` of start-sorted parts: fields without parts are empty, other parts null."""
    def nested(ps):
        new = F.transform(ps, lambda p: F.when(p["kind"] != "other", p["text"]))
        heads = F.filter(F.transform(ps, lambda p, i: F.when(p["part_ord"] == 0, F.struct(p["field_ord"].alias("f"), i.alias("at")))), lambda h: h.isNotNull())

        def fill(hs):
            # the run of fields up to the next head: the head's own texts, then empty fields
            def run(h, k):
                stop = F.coalesce(F.get(hs, k + 1)["at"], F.size(ps))
                own = F.slice(new, h["at"] + 1, stop - h["at"])
                gap = F.coalesce(F.get(hs, k + 1)["f"], h["f"] + 1) - h["f"] - 1
                return F.concat(F.array(own), F.array_repeat(F.array().cast("array<string>"), gap))

            lead = F.array_repeat(F.array().cast("array<string>"), F.coalesce(F.get(hs, F.lit(0))["f"], F.lit(0)))
            return F.concat(lead, F.flatten(F.transform(hs, run)))

        return let(heads, fill)

    return let(parts, nested)


@column_memo
def response_texts(v: Column, provider: Column) -> Column:
    """array<array<string>>: the texts of a response that may hold placeholders, null where a place has
    none: per OpenAI choice its message and its delta, per Anthropic block its text, per Gemini candidate
    its parts."""
    def string(o, path):
        s = F.try_variant_get(o, path, "variant")
        return F.when(P._is_string(s), F.try_variant_get(s, "$", "string"))

    def block(b):
        typed = F.coalesce(F.try_variant_get(b, "$.type", "string") == "text", F.lit(False))
        return F.array(F.when(typed, F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))))

    openai = F.transform(P._arr(v, "$.choices"), lambda c: F.array(string(c, "$.message.content"), string(c, "$.delta.content")))
    gemini = F.transform(P._arr(v, "$.candidates"), lambda c: F.transform(P._arr(c, "$.content.parts"), lambda p: string(p, "$.text")))
    return (F.when(provider == "openai", openai).when(provider == "anthropic", F.transform(P._arr(v, "$.content"), block))
             .when(provider == "gemini", gemini).otherwise(F.array().cast("array<array<string>>")))


@column_memo
def _restored_texts(texts: Column, mapping: Column) -> Column:
    return F.transform(texts, lambda inner: F.transform(inner, lambda s: pii.restore(s, mapping)))


@column_memo
def rewritten_response(v: Column, provider: Column, texts: Column) -> Column:
    """A response body, as canonical JSON, with ``texts`` in the places of ``response_texts``."""
    def at(i, j, name):
        new = F.get(F.get(texts, i), j)
        return lambda o: object_json(o, {name: lambda old: F.when(new.isNull(), _json(old)).otherwise(quoted(new))})

    def choice(c, i):  # one without a message gets an empty one
        message = lambda o: F.when(P._is_object(o), at(i, 0, "content")(o)).otherwise(F.lit("{}"))
        return object_json(c, {"message": message, "delta": at(i, 1, "content")}, {"message": F.lit("{}")})

    def block(b, i):
        new = F.get(F.get(texts, i), 0)
        return F.when(new.isNull(), _json(b)).otherwise(object_json(b, {"text": lambda _: quoted(new)}, {"text": quoted(new)}))

    def candidate(c, i):
        return object_json(c, {"content": lambda o: object_json(o, {"parts": lambda ps: array_json(ps, lambda p, j: at(i, j, "text")(p))})})

    return F.coalesce(F.when(provider == "openai", object_json(v, {"choices": lambda a: array_json(a, choice)}))
                       .when(provider == "anthropic", object_json(v, {"content": lambda a: array_json(a, block)}))
                       .when(provider == "gemini", object_json(v, {"candidates": lambda a: array_json(a, candidate)})), _json(v))


def restore_bodies(responses: DataFrame, mappings: DataFrame, id_col: str, v_col: str = "v", provider_col: str = "provider") -> DataFrame:
    """Every response with ``restored``, its body in canonical JSON with the placeholders of its
    texts restored (OpenAI messages and deltas, Anthropic text blocks, Gemini parts); a response whose
    request staged no mapping, or an empty one, stays as it is."""
    joined = responses.join(mappings.select(id_col, "mapping"), id_col, "left")
    texts = pii.fenced(joined, "_texts", _restored_texts(response_texts(F.col(v_col), F.col(provider_col)), F.col("mapping")))
    unmapped = F.coalesce(F.size(F.map_keys("mapping")) == 0, F.lit(True))
    body = F.when(unmapped, _json(F.col(v_col))).otherwise(rewritten_response(F.col(v_col), F.col(provider_col), F.col("_texts")))
    return pii.fenced(texts, "restored", body).drop("mapping", "_texts")
