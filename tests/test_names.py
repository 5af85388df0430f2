"""Gazetteer names and external spans against plain Python."""

import random
import re

from veilframe.operators import gazetteer as G
from veilframe.operators import pii
from veilframe.operators.recognizers import EntityPolicy, Recognizer

NAMES = [("PERSON", "Ann Lee", 0.9), ("PERSON", "Ann", 0.7), ("LOCATION", "Lee", 0.7), ("LOCATION", "New York City", 0.8), ("LOCATION", "New York", 0.8),
         ("PERSON", "Ann", 0.6), ("PERSON", None, 0.9), ("LOCATION", "Saint-Malo", 0.4)]
GAZETTEER = "entity string, phrase string, score double"


def texts():
    rnd = random.Random(3)
    words = ["Ann", "Lee", "New", "York", "City", "é", "日本", "Saint-Malo", "Anna", "x@y.org", "and,", "(Ann"]
    return [(i, "".join(rnd.choice(words) + rnd.choice([" ", "  ", "-", " "]) for _ in range(rnd.randint(0, 25)))) for i in range(80)] + [(100, None), (101, ""), (102, "Ann " * 4000)]


def named(text):
    out = set()
    for entity, phrase, score in {(e, p, max(s for a, b, s in NAMES if (a, b) == (e, p))) for e, p, _ in NAMES if p}:
        for m in re.finditer(f"(?<![A-Za-z0-9#])(?={re.escape(phrase)}(?![A-Za-z0-9#]))", text or ""):
            out.add((m.start(), m.start() + len(phrase), entity, score, phrase))
    return out


def test_names_in_texts(spark):
    rows = texts()
    got = G.named_spans(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(NAMES, GAZETTEER), "id").collect()
    assert {(r["id"], r["span_start"], r["span_end"], r["entity"], r["score"], r["value"]) for r in got} == {(i, *n) for i, t in rows for n in named(t)}


def test_external_spans_compete_under_the_policy(spark):
    rows = texts()
    mail = (Recognizer("EMAIL_ADDRESS", r"x@y\.org", 0.95),)
    d = G.with_named_spans(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(NAMES, GAZETTEER), "id")
    for policy in (EntityPolicy(), EntityPolicy(deny=("PERSON",)), EntityPolicy(allow=("PERSON", "EMAIL_ADDRESS"))):
        got = {r["id"]: r for r in pii.scrub(d, "text", recognizers=mail, policy=policy, external="external").collect()}
        for i, t in rows:
            cand = [n for n in named(t) if policy.admits(n[2]) and n[3] >= 0.5]
            cand += [(m.start(), m.end(), "EMAIL_ADDRESS", 0.95, m[0]) for m in re.finditer(r"x@y\.org", t or "")]
            kept = []
            for s in sorted(cand, key=lambda s: (-s[3], s[0] - s[1], s[0], s[2])):
                if all(s[1] <= k[0] or s[0] >= k[1] for k in kept[-50:] + kept[:0]) if len(cand) > 3000 else all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
                    kept.append(s)
            kept.sort()
            assert [(s["span_start"], s["span_end"], s["entity"], s["value"]) for s in got[i]["spans"]] == [(s[0], s[1], s[2], s[4]) for s in kept]
            if t is not None:
                out, at, n = [], 0, {}
                for s in kept:
                    n[s[2]] = n.get(s[2], 0) + 1
                    out += [t[at:s[0]], f"<{s[2]}_{n[s[2]]}>"]
                    at = s[1]
                assert got[i]["scrubbed_text"] == "".join(out) + t[at:]


def test_spans_outside_the_text_are_dropped(spark):
    ext = [(-1, 2, "PERSON", 0.9), (0, 3, "PERSON", 0.9), (2, 9, "PERSON", 0.9), (3, 3, "PERSON", 0.9), (0, 1, "US_SSN", 1.0), (1, 2, None, 1.0)]
    df = spark.createDataFrame([(1, "日本é x", ext), (2, None, ext), (3, "abc", None)], f"id long, text string, external {pii.EXTERNAL_ARRAY}")
    got = {r["id"]: r["spans"] for r in pii.detect_spans(df, "text", external="external").collect()}
    assert [(s["span_start"], s["span_end"], s["value"]) for s in got[1]] == [(0, 3, "日本é")]
    assert got[2] == [] and got[3] == []


def test_a_large_gazetteer_does_not_shuffle_the_ngrams(spark):
    """Names with a token that no text holds are cut before the join, so n-grams meet only the few that are left."""
    from pyspark.sql import functions as F

    many = spark.range(400_000).select(F.lit("PERSON").alias("entity"), F.concat(F.lit("Customer Nr"), F.col("id").cast("string")).alias("phrase"), F.lit(0.9).alias("score"))
    df = spark.createDataFrame([(1, "Ask Customer Nr17, Customer Nr 18 or Nr19 Customer"), (2, None)], "id long, text string")
    got = G.named_spans(df, many, "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(phrase" not in plan and "hashpartitioning(g#" not in plan
    assert [(r["id"], r["span_start"], r["value"]) for r in got.collect()] == [(1, 4, "Customer Nr17")]
