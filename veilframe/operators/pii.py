"""PII / secret detection, scrubbing, restoring and accounting.

All operators are row-local column expressions (zero shuffles for a corpus
scrub); aggregates on top of them use partial + final aggregation.

Span semantics: 0-based, half-open ``[span_start, span_end)`` in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.memo import column_memo
from veilframe.functions.spans import (
    PAIR_ARRAY,
    SPAN_ARRAY,
    let,
    luhn_ok,
    mod97_ok,
    pair_spans,
    regex_pairs,
    running,
    tokens_before,
)
from veilframe.operators.recognizers import (
    CONTEXT_BOOST,
    CONTEXT_FLOOR,
    CONTEXT_TOKENS,
    DEFAULT_RECOGNIZERS,
    PLACEHOLDER_REGEX,
    SCORE_THRESHOLD,
    EntityPolicy,
    Recognizer,
    select_recognizers,
)

SCRUB_MODES = ("reversible", "one_way")
EXTERNAL_ARRAY = "array<struct<span_start:int,span_end:int,entity:string,score:double>>"


def fenced(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """``df`` with the column ``name``, an expensive expression that is evaluated exactly once.

    The expression becomes the only element of an exploded array.  The optimizer never
    copies a generator's output into its consumers nor pushes a filter on it below the
    generator (as it would for a projection, re-running the regex scan), while filters
    on other columns and column pruning still pass through to the scan.  The
    expression is evaluated for every row that is left, also if nothing reads it.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(expr)).alias(name))


def _passes(rec: Recognizer, value: Column) -> Column:
    """The checks of a recognizer beside its pattern."""
    ok = F.lit(True)
    for req in rec.requires:
        ok = ok & value.rlike(req)
    if rec.checksum == "luhn":
        ok = ok & luhn_ok(value)
    elif rec.checksum == "mod97":
        ok = ok & mod97_ok(value)
    return ok


def _matches(text: Column, rec: Recognizer) -> Column:
    """Gap and match pairs of one recognizer.  A text without the literal anchor (or, lacking one,
    without any match of the pattern: one early-exit scan) skips the extract+split pair."""
    guard = text.contains(rec.anchor) if rec.anchor else text.rlike(rec.regex)
    return F.when(F.coalesce(guard, F.lit(False)), regex_pairs(text, rec.regex)).otherwise(F.array().cast(PAIR_ARRAY))


@column_memo
def candidate_spans(text: Column, recognizers=DEFAULT_RECOGNIZERS, policy: EntityPolicy | None = None,
                    threshold: float = SCORE_THRESHOLD) -> Column:
    """All recognizer matches scoring at least ``threshold`` (C1-C6), unresolved;
    array<struct<span_start, span_end, entity, score, value, byte_start>>.

    Only the patterns are spelled out for each recognizer; places, checks and scores are one
    expression over all of them, so the plan stays small however long the catalogue is."""
    recs = select_recognizers(tuple(recognizers), policy or EntityPolicy())
    if not recs:
        return F.array().cast(SPAN_ARRAY)
    entities = F.array(*[F.lit(r.entity) for r in recs])
    scores = F.array(*[F.lit(float(r.score)) for r in recs])
    words = F.array(*[F.array(*[F.lit(w) for w in r.context]).cast("array<string>") for r in recs])
    checked = [i for i, r in enumerate(recs) if r.requires or r.checksum]

    def passes(r, value):
        ok = F.lit(True)
        for i in checked:
            ok = F.when(r == i, _passes(recs[i], value)).otherwise(ok)
        return ok

    def scored(data, r, s):
        base, near = F.get(scores, r), F.get(words, r)
        boosted = F.least(F.lit(1.0), F.greatest(base + F.lit(CONTEXT_BOOST), F.lit(CONTEXT_FLOOR)))
        hit = F.exists(tokens_before(data, s["byte_start"], CONTEXT_TOKENS), lambda t: F.exists(near, lambda w: F.instr(t, w) > 0))
        return F.when((F.size(near) > 0) & hit, boosted).otherwise(base)

    def spans(data, pairs, r):
        kept = F.filter(pair_spans(pairs), lambda s: passes(r, s["value"]))
        return F.transform(kept, lambda s: F.struct(
            s["span_start"].alias("span_start"), s["span_end"].alias("span_end"), F.get(entities, r).alias("entity"),
            scored(data, r, s).alias("score"), s["value"].alias("value"), s["byte_start"].alias("byte_start")))

    each = F.array(*[_matches(text, r) for r in recs])
    found = let(text.cast("binary"), lambda data: F.flatten(F.transform(each, lambda pairs, r: F.when(
        F.size(pairs) > 0, spans(data, pairs, r)).otherwise(F.array().cast(SPAN_ARRAY)))))
    return F.filter(found, lambda s: s["score"] >= F.lit(threshold))


def _greedy(spans: Column) -> Column:
    """Spans of one island, visited by (score desc, length desc, start asc, entity asc):
    each one disjoint from every kept span stays."""
    keyed = F.transform(spans, lambda s: F.struct(
        (-s["score"]).alias("k1"), (s["span_start"] - s["span_end"]).alias("k2"),
        s["span_start"].alias("k3"), s["entity"].alias("k4"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])

    def step(acc, x):
        clash = F.exists(acc, lambda c: ~((x["span_end"] <= c["span_start"]) | (x["span_start"] >= c["span_end"])))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    return F.array_sort(F.aggregate(ordered, F.array().cast(SPAN_ARRAY), step))


@column_memo
def resolve_overlaps(spans: Column) -> Column:
    """Greedy overlap resolution (C7): visit spans by (score desc, length
    desc, start asc, entity asc) and keep each one disjoint from every kept
    span (touching is fine).  Returned sorted by start.

    A sweep over the spans in start order cuts them into islands wherever a span starts
    at or behind the furthest end so far; spans of different islands cannot clash, so
    the visit happens inside each island, and most islands are a single span."""
    def sweep(ordered):
        heads = running(ordered, F.lit(-1), lambda s: s["span_end"], F.greatest, lambda s, reach: s["span_start"] >= reach)
        return F.filter(F.transform(heads, lambda new, i: F.when(new, i)), lambda i: i.isNotNull())

    def islands(ordered):
        def island(head, k, heads):
            size = F.coalesce(F.get(heads, k + 1), F.size(ordered)) - head
            return F.when(size == 1, F.array(F.get(ordered, head))).otherwise(_greedy(F.slice(ordered, head + 1, size)))

        return let(sweep(ordered), lambda heads: F.flatten(F.transform(heads, lambda head, k: island(head, k, heads))))

    return let(F.array_sort(spans.cast(SPAN_ARRAY)), lambda ordered: F.when(F.size(ordered) > 1, islands(ordered)).otherwise(ordered))


@column_memo
def external_spans(text: Column, spans: Column, policy: EntityPolicy | None = None, threshold: float = SCORE_THRESHOLD) -> Column:
    """Spans (span_start, span_end, entity, score) from elsewhere, as candidates: under the
    entity policy and the threshold, inside the text, with their values and byte places.

    Byte places are found by walking from each span's start to the next, so the text is
    walked once."""
    policy = policy or EntityPolicy()

    def wanted(s):
        ok = ~s["entity"].isin(*policy.deny) if policy.deny else F.lit(True)
        if policy.allow is not None:
            ok = ok & s["entity"].isin(*policy.allow)
        inside = (s["span_start"] >= 0) & (s["span_start"] < s["span_end"]) & (s["span_end"] <= F.length(text))
        return F.coalesce(ok & inside & (s["score"] >= threshold), F.lit(False))

    def head(data, at, n):  # the first n characters from a byte place; none takes over four bytes
        return F.substring(F.substring(data, at + 1, n * 4).cast("string"), F.lit(1), n)

    def placed(data):
        start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"), F.array().cast(SPAN_ARRAY).alias("out"))

        def step(acc, s):
            at = acc["b"] + F.octet_length(head(data, acc["b"], s["span_start"] - acc["c"]))
            return let(at, lambda b: F.struct(s["span_start"].alias("c"), b.alias("b"), F.concat(acc["out"], F.array(F.struct(
                s["span_start"].alias("span_start"), s["span_end"].alias("span_end"), s["entity"].alias("entity"), s["score"].alias("score"),
                head(data, b, s["span_end"] - s["span_start"]).alias("value"), b.alias("byte_start")))).alias("out")))

        ordered = F.array_sort(F.filter(spans.cast(EXTERNAL_ARRAY), wanted))
        return F.aggregate(ordered, start, step, lambda acc: acc["out"])

    return F.when(F.coalesce(F.size(spans) > 0, F.lit(False)) & text.isNotNull(), let(text.cast("binary"), placed)).otherwise(F.array().cast(SPAN_ARRAY))


def detect_spans(df: DataFrame, text_col: str = "text", out: str = "spans",
                 recognizers=DEFAULT_RECOGNIZERS, policy: EntityPolicy | None = None,
                 threshold: float = SCORE_THRESHOLD, external: str | None = None) -> DataFrame:
    """C4: resolved spans per row.  ``external`` names a column of spans from elsewhere (a
    gazetteer, a model) that compete with the recognizers' under the same policy.

    Stages are separate generators referenced by name, so each expensive array
    is computed once and filters on other columns still reach the scan."""
    cand = candidate_spans(F.col(text_col), recognizers, policy, threshold)
    if external is not None:
        cand = F.concat(cand, external_spans(F.col(text_col), F.col(external), policy, threshold))
    found = fenced(df, "_cand", cand)
    return fenced(found, out, resolve_overlaps(F.col("_cand"))).drop("_cand")


@column_memo
def placeholder_indexes(spans: Column, mode: str = "reversible") -> Column:
    """The number of each of the start-sorted ``spans`` (entity, value), in their order.

    reversible: its occurrence number within the entity; one_way: the rank of its value among
    the entity's distinct values by first appearance.  Spans are taken apart by entity
    (a catalogue holds few), then sorted, so many spans cost n log n."""
    if mode not in SCRUB_MODES:
        raise ValueError(f"mode must be one of {SCRUB_MODES}")

    def occurrences(mine):
        return F.transform(mine, lambda y, r: F.struct(y["i"].alias("i"), (r + 1).alias("n")))

    def values(mine):
        def ranked(by_value):
            heads = F.filter(F.transform(by_value, lambda y, j: F.when((j == 0) | (F.get(by_value, j - 1)["value"] != y["value"]), F.struct(
                y["i"].alias("i"), j.alias("at")))), lambda h: h.isNotNull())
            return let(heads, lambda hs: let(rank_of(hs), lambda ranks: F.flatten(F.transform(hs, lambda h, g: F.transform(
                F.slice(by_value, h["at"] + 1, F.coalesce(F.get(hs, g + 1)["at"], F.size(by_value)) - h["at"]),
                lambda y: F.struct(y["i"].alias("i"), F.get(ranks, g)["n"].alias("n")))))))

        def rank_of(heads):  # in value order: the place of each value by its first appearance
            first = F.array_sort(F.transform(heads, lambda h, g: F.struct(h["i"].alias("i"), g.alias("g"))))
            return F.array_sort(F.transform(first, lambda h, r: F.struct(h["g"].alias("g"), (r + 1).alias("n"))))

        return let(F.array_sort(F.transform(mine, lambda y: F.struct(y["value"].alias("value"), y["i"].alias("i")))), ranked)

    def number(sp):
        placed = F.transform(sp, lambda x, i: F.struct(x["entity"].alias("entity"), x["value"].alias("value"), i.alias("i")))
        kinds = F.array_distinct(F.transform(sp, lambda x: x["entity"]))
        one = occurrences if mode == "reversible" else values
        each = let(placed, lambda p: F.flatten(F.transform(kinds, lambda k: one(F.filter(p, lambda y: y["entity"] == k)))))
        return F.transform(F.array_sort(each), lambda x: x["n"])

    return let(spans, lambda sp: F.when(F.size(sp) > 0, number(sp)).otherwise(F.array().cast("array<int>")))


@column_memo
def with_placeholders(spans: Column, mode: str = "reversible") -> Column:
    """Add ``placeholder`` to start-sorted spans.

    reversible: ``<ENTITY_n>``, n = occurrence number of the entity;
    one_way: n = rank of the value among the entity's distinct values by
    first appearance, so equal values share a placeholder."""
    return let(placeholder_indexes(spans, mode), lambda numbers: F.transform(spans, lambda x, i: F.struct(
        x["span_start"].alias("span_start"), x["span_end"].alias("span_end"),
        x["entity"].alias("entity"), x["score"].alias("score"), x["value"].alias("value"), x["byte_start"].alias("byte_start"),
        F.concat(F.lit("<"), x["entity"], F.lit("_"), F.get(numbers, i).cast("string"), F.lit(">")).alias("placeholder"))))


@column_memo
def rebuild_text(text: Column, ph_spans: Column) -> Column:
    """Gaps between start-sorted, disjoint spans joined with placeholders, cut out
    of the text's bytes in one pass."""
    def rebuilt(data, spans):
        after = lambda s: s["byte_start"] + F.octet_length(s["value"])

        def piece(x, i):
            prev_end = F.when(i == 0, F.lit(0)).otherwise(after(F.get(spans, i - 1)))
            return F.concat(F.substring(data, prev_end + 1, x["byte_start"] - prev_end).cast("string"), x["placeholder"])

        last_end = F.coalesce(after(F.get(spans, F.size(spans) - 1)), F.lit(0))
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(data, last_end + 1, F.octet_length(data)).cast("string"))

    whole = let(ph_spans, lambda spans: let(text.cast("binary"), lambda data: rebuilt(data, spans)))
    return F.when(text.isNull(), F.lit(None).cast("string")).when(F.size(ph_spans) == 0, text).otherwise(whole)


def placeholder_map(spans: Column, mode: str) -> Column:
    """Placeholder -> original of numbered spans (empty in one_way mode)."""
    if mode == "reversible":
        return F.map_from_arrays(F.transform(spans, lambda x: x["placeholder"]), F.transform(spans, lambda x: x["value"]))
    return F.create_map().cast("map<string,string>")


def scrub(df: DataFrame, text_col: str = "text", mode: str = "reversible",
          recognizers=DEFAULT_RECOGNIZERS, policy: EntityPolicy | None = None,
          threshold: float = SCORE_THRESHOLD, prefix: str = "", external: str | None = None) -> DataFrame:
    """Scrub ``text_col``: adds ``{prefix}spans`` (with placeholders),
    ``{prefix}scrubbed_text`` and ``{prefix}mapping`` (placeholder -> original;
    empty in one_way mode)."""
    spans_c = f"{prefix}spans"
    out = detect_spans(df, text_col, "_kept", recognizers, policy, threshold, external)
    out = fenced(out, spans_c, with_placeholders(F.col("_kept"), mode)).drop("_kept")
    out = fenced(out, f"{prefix}scrubbed_text", rebuild_text(F.col(text_col), F.col(spans_c)))
    return out.withColumn(f"{prefix}mapping", placeholder_map(F.col(spans_c), mode))


def _looked_up(keys: Column, mapping: Column) -> Column:
    """``mapping[key]`` of each key, or the key itself.  Entries and keys are sorted
    together and every key takes the entry before it if that is its own: a map is
    searched entry by entry, which many placeholders would make quadratic."""
    entries = F.transform(F.map_entries(F.coalesce(mapping, F.create_map().cast("map<string,string>"))), lambda e: F.struct(
        e["key"].alias("k"), F.lit(-1).alias("i"), e["value"].alias("v")))
    asked = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"), F.lit(None).cast("string").alias("v")))
    state = lambda x: F.struct((x["i"] < 0).alias("is"), x["k"].alias("k"), x["v"].alias("v"))
    none = F.struct(F.lit(False).alias("is"), F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("v"))
    found = running(F.array_sort(F.concat(entries, asked)), none, state, lambda a, b: F.when(b["is"], b).otherwise(a), lambda x, before: F.struct(
        x["i"].alias("i"), F.coalesce(F.when(before["k"] == x["k"], before["v"]), x["k"]).alias("v")))
    return F.transform(F.array_sort(F.filter(found, lambda x: x["i"] >= 0)), lambda x: x["v"])


@column_memo
def restore(text: Column, mapping: Column) -> Column:
    """C14: single left-to-right pass replacing ``<ENTITY_n>`` placeholders
    found in ``mapping``; unknown placeholders are kept; not recursive."""
    t = F.coalesce(text, F.lit(""))
    ms = F.regexp_extract_all(t, F.lit(PLACEHOLDER_REGEX), F.lit(0))
    gaps = F.split(t, PLACEHOLDER_REGEX, -1)
    repl = let(ms, lambda found: F.when(F.size(found) > 0, _looked_up(found, mapping)).otherwise(found))
    joined = F.array_join(F.zip_with(gaps, F.concat(repl, F.array(F.lit(""))), lambda g, r: F.concat(g, r)), "")
    return F.when(text.isNull(), F.lit(None).cast("string")).otherwise(joined)


@column_memo
def mapping_string(mapping: Column) -> Column:
    """Deterministic text form of a mapping, for reports and comparisons."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(mapping),
                                                 lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\u0001")


def category_counts(spans: Column) -> Column:
    """array<struct<entity, n>> sorted by entity (C11)."""
    cats = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity"])))
    return F.transform(cats, lambda c: F.struct(
        c.alias("entity"), F.size(F.filter(spans, lambda s: s["entity"] == c)).alias("n")))


@column_memo
def pii_header(spans: Column) -> Column:
    """``CAT:n,CAT:n`` sorted by category; empty string when none."""
    return F.array_join(F.transform(category_counts(spans),
                                    lambda c: F.concat(c["entity"], F.lit(":"), c["n"].cast("string"))), ",")


def sorted_categories(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity"])))


def pii_totals(df: DataFrame, spans_col: str = "spans") -> DataFrame:
    """C20: detections per category (explode + partial/final aggregate)."""
    return (df.select(F.explode(spans_col).alias("s"))
              .groupBy(F.col("s.entity").alias("entity"))
              .agg(F.count(F.lit(1)).alias("n")))


def roundtrip_violations(scrubbed: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """Rows where restore(scrub(t)) != t, excluding texts that already
    contain a placeholder literal (those are rewritten by design)."""
    restored = restore(F.col("scrubbed_text"), F.col("mapping"))
    return (scrubbed.where(~F.col(text_col).rlike(PLACEHOLDER_REGEX))
                    .where(~restored.eqNullSafe(F.col(text_col)))
                    .select(*key_cols))


def fail_policy(df: DataFrame, text_col: str = "text", on_error: str = "closed") -> tuple[DataFrame, DataFrame]:
    """C17: texts that cannot be scrubbed (NULL; a text of any length can be)
    go to a rejects side output with ``PII_SCRUBBER_UNAVAILABLE`` when failing
    closed; failing open passes them on with zero detections.

    Returns (to_scrub, rejects)."""
    bad = F.col(text_col).isNull()
    if on_error == "closed":
        rejects = df.where(bad).withColumn("error_code", F.lit("PII_SCRUBBER_UNAVAILABLE"))
        return df.where(~bad), rejects
    return df.withColumn("scrub_passthrough", bad), df.where(F.lit(False)).withColumn(
        "error_code", F.lit(None).cast("string"))
