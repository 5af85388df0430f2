"""Leak audit, i.e. which haystack rows contain which known sensitive
values (tripwires), verbatim.

Exact containment without comparing every pair, in one lazy plan of joins; nothing
is collected and no dictionary is built, and ids may be of any type:

* A tripwire of at least five whitespace-separated tokens has interior tokens
  that are delimited by whitespace inside the tripwire, so wherever it
  occurs they are whole tokens of the haystack, consecutive.  Its anchor is
  the hash of one interior run of three tokens, the longest one in characters
  (long words are rare words).  Haystack rows emit the hashes of their token
  runs (a row-local generator) and an equi-join on the hash yields candidates.
* A shorter tripwire (keys, e-mail addresses) can begin and end inside a longer
  token, but its longest token is a piece of one haystack token.  Pieces are
  looked for in the distinct tokens of a row, by hashed byte grams of
  fixed widths: of a piece's grams the one that fewest tokens hold is its
  anchor, an equi-join on it yields tokens, ``instr`` verifies that they hold
  the piece, and the rows that hold such a token are candidates.

What is shuffled follows the matches, not the haystack: before any exchange, runs, grams
and texts pass a filter made of the other side's hashes (a value of fixed size, a scalar
subquery), tokens shorter than every piece are left out, and so are widths that no piece
uses.  The filters let too much through, never too little; joins and checks follow.

A token that holds a tripwire of one token proves it; all other candidates are verified
with ``instr`` on the text.  Which side of a join is broadcast is left to the optimizer's
size checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.spans import let
from veilframe.operators.pii import fenced
from veilframe.plans.layout import spread

WS = r"\s+"
Q = 3                      # tokens of an anchor run
LONG = Q + 2               # tokens from which a tripwire has such a run inside
WIDTHS = (1, 4, 8)   # bytes of a gram; a piece uses the widest that fits
WORDS = 1 << 14      # 64-bit words of a filter


def _tokens(text: Column) -> Column:
    return F.split(text, WS, -1)


def _run_hash(hashes: Column, start: Column) -> Column:
    """Hash of the token hashes of the run at 0-based ``start``."""
    return F.xxhash64(*[F.get(hashes, start + k) for k in range(Q)])


def _token_runs(hashes: Column) -> Column:
    """Distinct hashes of all runs of a token list."""
    return F.when(F.size(hashes) >= Q, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(hashes) - Q), lambda i: _run_hash(hashes, i)))).otherwise(F.array().cast("array<bigint>"))


def _long_anchors(needles: DataFrame) -> DataFrame:
    """(needle_id, needle_text, h) of tripwires with at least ``LONG`` tokens."""
    toks = needles.where(F.size(_tokens(F.col("needle_text"))) >= LONG).withColumn("toks", _tokens(F.col("needle_text")))
    runs = F.transform(F.sequence(F.lit(1), F.size("toks") - 1 - Q), lambda i: F.struct(
        sum((F.length(F.get("toks", i + k)) for k in range(Q)), F.lit(0)).alias("chars"),
        F.xxhash64(*[F.xxhash64(F.get("toks", i + k)) for k in range(Q)]).alias("h")))
    return toks.select("needle_id", "needle_text", F.array_max(runs)["h"].alias("h"))


def _grams(data: Column, width: Column) -> Column:
    """Hashes of all grams of ``width`` bytes (cutting a binary does not walk it)."""
    n = F.octet_length(data) - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(width, F.substring(data, i, width)))).otherwise(
        F.array().cast("array<bigint>"))


def _pieces(needles: DataFrame) -> DataFrame:
    """(needle_id, needle_text, piece, width, g): the grams of each short tripwire's longest token."""
    short = needles.where(F.size(_tokens(F.col("needle_text"))) < LONG)
    longest = F.array_max(F.transform(_tokens(F.col("needle_text")), lambda t: F.struct(F.octet_length(t).alias("n"), t.alias("t"))))
    piece = short.withColumn("piece", longest["t"]).where("piece <> ''")
    fit = F.lit(WIDTHS[0])
    for w in WIDTHS[1:]:
        fit = F.when(F.octet_length("piece") >= w, w).otherwise(fit)
    grams = let(F.col("piece").cast("binary"), lambda data: F.array_distinct(_grams(data, fit)))
    return piece.select("needle_id", "needle_text", "piece", fit.alias("width"), F.explode(grams).alias("g"))


def _filter(hashes: DataFrame) -> Column:
    """The hashes of the only column as bits: one value, made when the plan that uses it runs."""
    slot = F.pmod(F.col(hashes.columns[0]), F.lit(64 * WORDS))
    some = hashes.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bits"))
    empty = hashes.sparkSession.range(0, WORDS, 1, 1).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = empty.unionByName(some).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])).scalar()


def _passes(bits: Column, h: Column) -> Column:
    slot = F.pmod(h, F.lit(64 * WORDS))
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1


def _merged(df: DataFrame, forced: bool) -> DataFrame:
    return df.hint("merge") if forced else df


def _long_candidates(hay: DataFrame, needles: DataFrame, forced: bool) -> DataFrame:
    anchors = _long_anchors(needles)
    # the token hashes are their own (fenced) column: referenced from inside the
    # lambda as an expression they would be computed anew for every position
    staged = fenced(hay.where(anchors.agg(F.count(F.lit(1)) > 0).scalar()), "_th", F.transform(_tokens(F.col("hay_text")), lambda w: F.xxhash64(w)))
    probe = staged.select("hay_id", F.explode(_token_runs(F.col("_th"))).alias("h")).where(_passes(_filter(anchors.select("h")), F.col("h")))
    return probe.join(_merged(anchors, forced), "h").select("hay_id", "needle_id", "needle_text", F.lit(False).alias("sure"))


def _short_candidates(hay: DataFrame, needles: DataFrame, forced: bool) -> DataFrame:
    """(hay_id, needle_id, needle_text, sure): a token of the row holds the tripwire's longest token, for
    ``sure`` all of it."""
    pieces = _pieces(needles)
    asked = pieces.agg(F.struct(F.min(F.octet_length("piece")).alias("least"), *[(F.count_if(F.col("width") == w) > 0).alias(f"w{w}") for w in WIDTHS])).scalar()
    long_enough = hay.where(F.octet_length("hay_text") >= asked["least"])
    tokens = long_enough.select("hay_id", F.explode(F.array_distinct(_tokens(F.col("hay_text")))).alias("token")).where(F.octet_length("token") >= asked["least"])
    grams = [F.when(asked[f"w{w}"], _grams(F.col("token").cast("binary"), F.lit(w))).otherwise(F.array().cast("array<bigint>")) for w in WIDTHS]
    held = tokens.select("hay_id", "token", F.explode(F.array_distinct(F.concat(*grams))).alias("g"))
    often = held.where(_passes(_filter(pieces.select("g")), F.col("g"))).groupBy("g").agg(F.count(F.lit(1)).alias("tokens"))
    # a piece with a gram that no token holds occurs nowhere: its anchor meets none
    rarest = pieces.join(_merged(often, forced), "g", "left").groupBy("needle_id", "needle_text", "piece").agg(
        F.min(F.struct(F.coalesce("tokens", F.lit(0)).alias("tokens"), "g"))["g"].alias("g"))
    found = held.where(_passes(_filter(rarest.select("g")), F.col("g"))).join(_merged(rarest, forced), "g").where(F.instr(F.col("token"), F.col("piece")) > 0)
    return found.select("hay_id", "needle_id", "needle_text", (F.col("piece") == F.col("needle_text")).alias("sure"))


def leak_pairs(haystack: DataFrame, hay_id: str, hay_text: str, needles: DataFrame, needle_id: str,
               needle_text: str, broadcast_max_rows: int | None = None) -> DataFrame:
    """(hay_id, needle_id) for every haystack row that contains a tripwire.

    Null and blank tripwires are ignored, null texts hold none.  Building the plan starts no
    job.  ``broadcast_max_rows=0`` asks for sort-merge joins wherever a table follows
    the tripwires, for sets that are known to be large."""
    forced = broadcast_max_rows == 0
    n = needles.select(F.col(needle_id).alias("needle_id"), F.col(needle_text).cast("string").alias("needle_text")).where(
        F.col("needle_text").isNotNull()).distinct()
    hay = haystack.select(F.col(hay_id).alias("hay_id"), F.col(hay_text).cast("string").alias("hay_text"))
    wide = spread(hay)
    cand = _long_candidates(wide, n, forced).unionByName(_short_candidates(wide, n, forced)).distinct()
    open_ = cand.where(~F.col("sure")).select(F.xxhash64("hay_id"))
    texts = hay.select(F.col("hay_id").alias("_id"), "hay_text").where(_passes(_filter(open_), F.xxhash64("_id")))
    held = cand.join(texts, F.col("hay_id").eqNullSafe(F.col("_id")), "left").where(F.col("sure") | (F.instr(F.col("hay_text"), F.col("needle_text")) > 0))
    return held.select("hay_id", "needle_id").distinct()
