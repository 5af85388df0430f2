"""Column expressions that turn regex matches into character spans.

Spark has no ``regexp_instr_all``; offsets come from the pair
``regexp_extract_all(t, p)`` / ``split(t, p, -1)``: the text is
``gap0 m0 gap1 m1 ... gapN``, so the start of match *i* is the summed length of
everything before it.  All offsets are 0-based, half-open, in code points
(Spark ``length``/``substring`` count code points, as Python does); each span also
carries where it starts in bytes, because cutting a piece out of a binary does not
walk the text before it.

Everything here is a built-in expression: it runs inside the scan's stage,
needs no shuffle and no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "struct<span_start:int,span_end:int,entity:string,score:double,value:string,byte_start:int>"
SPAN_ARRAY = f"array<{SPAN_TYPE}>"
PAIR_ARRAY = "array<struct<g:string,m:string>>"
CHUNK = 256  # elements folded at a time by ``running``


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(arr: Column, zero: Column, value: Callable, merge: Callable, emit: Callable) -> Column:
    """A running fold of an array: ``emit(x, before)`` for each element, where ``before``
    merges ``value(y)`` of all elements before it (``zero`` for the first).

    ``merge`` must be associative with ``zero`` neutral.  Elements are folded in
    chunks, each from the merged state of the chunks before it, so that growing the
    output never copies more than one chunk: the cost is linear in the array.
    """
    def chunks(a):
        at = F.sequence(F.lit(0), ((F.size(a) - 1) / CHUNK).cast("int"))
        return F.transform(at, lambda c: F.slice(a, c * CHUNK + 1, F.lit(CHUNK)))

    def fold(parts):
        sums = F.transform(parts, lambda one: F.aggregate(one, zero, lambda s, x: merge(s, value(x))))
        starts = F.aggregate(sums, F.array(zero), lambda acc, s: F.concat(acc, F.array(merge(F.element_at(acc, -1), s))))
        return let(starts, lambda st: F.flatten(F.transform(parts, lambda one, c: within(one, F.get(st, c)))))

    def within(one, start):
        # the state before each element of the chunk, then the elements zipped with it
        states = F.aggregate(one, F.array(start), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), value(x)))))
        return let(states, lambda st: F.transform(one, lambda x, i: emit(x, F.get(st, i))))

    return let(arr, lambda a: F.when(F.size(a) > 0, let(chunks(a), fold)).otherwise(F.transform(a, lambda x: emit(x, zero))))


def regex_pairs(text: Column, regex: str) -> Column:
    """array<struct<g, m>>: all non-overlapping leftmost-first matches of ``regex`` in ``text``, each
    with the gap before it (empty for NULL text).  Each of the two regex calls runs once."""
    t = F.coalesce(text, F.lit(""))
    ms = F.regexp_extract_all(t, F.lit(regex), F.lit(0))
    # there is one gap more than matches: zip_with pads that last pair with a NULL match
    pairs = F.zip_with(F.split(t, regex, -1), ms, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.filter(pairs, lambda x: x["m"].isNotNull())


def pair_spans(pairs: Column) -> Column:
    """array<struct<span_start, span_end, value, byte_start>> of gap and match pairs."""
    size = lambda c, b: F.struct(c.cast("int").alias("c"), b.cast("int").alias("b"))

    def span(x, before):
        start = before["c"] + F.length(x["g"])
        return F.struct(start.alias("span_start"), (start + F.length(x["m"])).alias("span_end"), x["m"].alias("value"),
                        (before["b"] + F.octet_length(x["g"])).alias("byte_start"))

    return running(pairs, size(F.lit(0), F.lit(0)),
                   lambda x: size(F.length(x["g"]) + F.length(x["m"]), F.octet_length(x["g"]) + F.octet_length(x["m"])),
                   lambda a, b: size(a["c"] + b["c"], a["b"] + b["b"]), span)


def luhn_ok(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.call_function("luhn_check", digits)


def mod97_ok(value: Column) -> Column:
    """IBAN check: move the first four characters to the end, letters become
    10..35, and the number must be 1 modulo 97 (computed digit by digit)."""
    v = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    rearranged = F.concat(v.substr(F.lit(5), F.length(v)), v.substr(F.lit(1), F.lit(4)))
    chars = F.split(rearranged, "", -1)

    def step(acc, c):
        code = F.ascii(c)
        is_digit = (code >= 48) & (code <= 57)
        num = F.when(is_digit, code - 48).otherwise(code - 55).cast("long")
        return F.when(is_digit, (acc * 10 + num) % 97).otherwise((acc * 100 + num) % 97)

    rem = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0).cast("long"), step)
    return rem == 1


WINDOWS = (96, 1536, 24576)  # bytes before a span that are read first, then further back


def tokens_before(data: Column, byte_start: Column, n_tokens: int) -> Column:
    """The last ``n_tokens`` lower-cased ``[A-Za-z0-9_]+`` tokens of the UTF-8 bytes ``data``
    before ``byte_start``.

    A window of bytes is read that grows until it holds one token more than asked (the
    first one may be cut) or reaches the start of the text, so the cost of a span follows
    the tokens before it, not its place."""
    def tokens(width):
        first = F.greatest(byte_start - width, F.lit(0))
        return F.regexp_extract_all(F.substring(data, first + 1, byte_start - first).cast("string"), F.lit("[A-Za-z0-9_]+"), F.lit(0))

    def last(toks):
        return F.slice(toks, F.greatest(F.size(toks) - (n_tokens - 1), F.lit(1)), F.lit(n_tokens))

    found = last(tokens(byte_start))
    for width in reversed(WINDOWS):
        wider = found
        found = let(tokens(F.lit(width)), lambda t: F.when((byte_start <= width) | (F.size(t) > n_tokens), last(t)).otherwise(wider))  # noqa: B023
    return F.transform(found, F.lower)


def context_tokens(text: Column, start: Column, n_tokens: int) -> Column:
    """``tokens_before`` for a place given in code points."""
    return let(F.substring(text, F.lit(1), start).cast("binary"), lambda d: tokens_before(d, F.octet_length(d), n_tokens))
