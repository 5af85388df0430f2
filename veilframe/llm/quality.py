"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far each can be
trusted, the posterior decides (DataFrame operations only)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import documents, stored

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# fixed values: frequent function words of the four languages
STOP_WORDS = ["the", "of", "and", "to", "in", "that", "is", "with", "was", "for", "der", "die", "und", "das", "den", "ein", "zu", "von", "mit", "nicht",
              "le", "la", "les", "des", "et", "une", "est", "dans", "que", "pour", "el", "los", "las", "del", "por", "una", "con", "no", "se", "su"]
# Each rule: name, measure, votes good up to, votes bad beyond (a rule between its bounds abstains, as
# it does without a measure; bounds in descending order say that more is better).
RULES = (
    ("symbols", "n_symbols / n_words", 0.05, 0.25),
    ("capitals", "n_capitals / word_chars", 0.15, 0.4),
    ("shouting", "n_marks / n_words", 0.1, 0.4),
    ("repeats", "n_repeat_words / n_words", 0.02, 0.1),
    ("lines", "if(n_lines >= 5, n_dup_lines / n_lines, null)", 0.0, 0.3),
    ("loose", "n_loose / n_words", 0.02, 0.1),
    ("plain", "n_plain / n_words", 0.8, 0.5),
    ("variety", "n_distinct / n_words", 0.3, 0.15),
    ("function", "if(n_words >= 50, n_stop, null)", 2.0, 1.0),
    ("length", "n_words", 50.0, 10.0),
    ("word_size", "abs(word_chars / n_words - 6)", 3.0, 6.0),
)
ROUNDS = 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with what the rules read: counts over the whole text.

    Windows are first compared by hash; only a text in which hashes repeat has its windows
    spelled out and compared as strings, so a hash collision changes nothing.
    """
    text = F.col("text")
    words = docs.withColumn("words", F.array_remove(F.split(text, SPACE, -1), "")).withColumn("n_words", F.size("words"))
    dense = words.withColumn("dense", F.translate(text, BLANKS, "")).withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    hashed = dense.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    keys = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    windows = hashed.withColumn("windows", F.expr(f"if(n_words > {WINDOW}, transform(sequence(0, n_words - {WINDOW}), i -> xxhash64({keys})), cast(array() as array<bigint>))"))
    plain = F.translate(F.col("dense"), SYMBOLS, "")
    counted = windows.select(
        "doc_id", "words", F.col("n_words").cast("long").alias("n_words"), F.length("dense").cast("long").alias("word_chars"),
        (F.length("dense") - F.length(plain)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"),
        (F.length("dense") - F.length(F.regexp_replace("dense", r"\p{Lu}++", ""))).alias("n_capitals"),
        (F.length("dense") - F.length(F.regexp_replace("dense", "[!?]++", ""))).alias("n_marks"),
        F.size(F.filter("words", lambda w: ~w.rlike(r"[\p{L}\p{N}]"))).alias("n_loose"),
        F.size(F.filter("words", lambda w: w.rlike(r"^\p{L}++[.,;:!?]?$"))).alias("n_plain"),
        F.size(F.array_distinct("words")).alias("n_distinct"), F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in STOP_WORDS]))).alias("n_stop"),
        (F.size("windows") > F.size(F.array_distinct("windows"))).alias("again"))
    ordered = counted.withColumn("pairs", F.when(F.col("again"), F.sort_array(F.expr(
        f"transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> struct(concat_ws(' ', " + ", ".join(f"words[i + {k}]" for k in range(WINDOW)) + ") as w, i as i))"))))
    same = ordered.withColumn("at", F.expr(
        "array_sort(transform(filter(pairs, (p, j) -> (j > 0 and p.w = get(pairs, j - 1).w) or coalesce(p.w = get(pairs, j + 1).w, false)), p -> p.i))"))
    covered = F.expr(f"aggregate(transform(at, (p, j) -> least({WINDOW}, coalesce(get(at, j + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)")
    return same.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("words", "pairs", "at", "again")


def votes() -> list[Column]:
    """Each rule's vote on a measured row: 1 good, -1 bad, 0 for no opinion (also where there is nothing to measure)."""
    found = []
    for name, measure, good, bad in RULES:
        x = F.expr("cast(" + re.sub(r"/ (\w+)", r"/ nullif(\1, 0)", measure) + " as double)")
        yes, no = (x <= good, x > bad) if good < bad else (x >= good, x < bad)
        found.append(F.when(yes, 1).when(no, -1).otherwise(0).alias(name))
    return found


def estimate(patterns: list[tuple]) -> tuple[float, list[dict[int, float]]]:
    """EM over vote patterns ``(votes..., count)``: the log odds of a good text and, per rule, the
    log odds that each of its votes adds.

    A rule's accuracy is kept for each class apart (how often its vote is good on good texts and
    on bad ones), because a rule may know one fault only, and then its good votes say little. An
    abstaining rule adds nothing. Classes start from the votes, a bad one counting as four good
    ones, and are named by their mean vote in the end.
    """
    k = len(RULES)
    start = lambda v: 1 / (1 + math.exp(-(sum(x for x in v if x > 0) - 4 * sum(1 for x in v if x < 0))))
    prob = {p[:k]: start(p[:k]) for p in patterns}
    prior, added = 0.0, [{-1: 0.0, 1: 0.0} for _ in range(k)]
    for _ in range(ROUNDS if patterns else 0):
        mass, seen = [1.0, 1.0], [[{-1: 1.0, 0: 0.0, 1: 1.0} for _ in range(k)] for _ in (0, 1)]
        for p in patterns:
            for y, share in ((1, prob[p[:k]] * p[k]), (0, (1 - prob[p[:k]]) * p[k])):
                mass[y] += share
                for j in range(k):
                    seen[y][j][p[j]] += share
        rate = lambda y, j, v: seen[y][j][v] / (seen[y][j][-1] + seen[y][j][1])  # noqa: E731, B023
        prior = math.log(mass[1] / mass[0])
        added = [{v: math.log(rate(1, j, v) / rate(0, j, v)) for v in (-1, 1)} for j in range(k)]
        prob = {v: 1 / (1 + math.exp(-max(-50.0, min(50.0, prior + sum(added[j].get(v[j], 0.0) for j in range(k)))))) for v in prob}
    lean = lambda y: sum(sum(p[:k]) * p[k] * (prob[p[:k]] if y else 1 - prob[p[:k]]) for p in patterns) / max(
        1e-9, sum(p[k] * (prob[p[:k]] if y else 1 - prob[p[:k]]) for p in patterns))
    if lean(1) < lean(0):
        prior, added = -prior, [{v: -x for v, x in a.items()} for a in added]
    return prior, added


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, the measures of ``MEASURES``, base_failed, kept,
    posterior (probability of a good text) and each rule's vote.

    Two passes over a stored table of measures and votes: votes are counted by pattern (eleven rules of
    three votes, so at most 3^11 rows reach the driver, however large the corpus), EM runs over
    these, and the posterior is a sum of one constant per vote. Kept are rows whose base checks
    hold (10 words, at most 20 % of them in repeated windows) and whose posterior is at least 0.5.

    A null or empty text has no words, so it fails. Null ids and repeated rows give a row each; an
    empty table gives an empty result; only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = [r[0] for r in RULES]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    voted = stored(measured(rows).select("doc_id", *MEASURES, failed.alias("base_failed"), *votes()), "quality-votes")
    patterns = [tuple(r) for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]
    prior, added = estimate(sorted(patterns))
    odds = F.lit(prior)
    for name, weight in zip(names, added, strict=True):
        odds = odds + F.when(F.col(name) == 1, weight[1]).when(F.col(name) == -1, weight[-1]).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-odds))
    return voted.withColumn("posterior", posterior).select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"), "posterior", *names)


def op11_quality(spark, sf_dir) -> DataFrame:
    return quality(documents(spark, sf_dir))
