"""Leak-audit queries (C18): benchmark passages inside documents, and the
tripwire values inside raw versus scrubbed texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import leak as L
from veilframe.operators import pii
from veilframe.plans.pii_queries import _secret_src, secret_texts, with_secrets
from veilframe.plans.pii_sql import scrub_ctes
from veilframe.plans.registry import register, sql_str
from veilframe.session import written
from veilframe.sources.tables import load

# Tripwires: three of the planted secrets, one half of a planted secret's line that no
# recognizer covers, and an address that no text holds.
TRIPWIRES = (
    ("openai_key", "sk-" + "Qz7" * 16),
    ("github_token", "ghp_" + "k3J9" * 9),
    ("aws_access_key", "AKIA" + "Q2W3E4R5T6Y7U8I9"),
    ("dsn_without_password", "postgres://warehouse.example.org"),
    ("email", "nobody.tripwire@example.net"),
)


@register("leak_pairs", operators=("C18",), oracle="""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def q_leak_pairs(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    b = load(spark, sf, "benchmark").select("item_id", "text")
    p = L.leak_pairs(d, "doc_id", "text", b, "item_id", "text")
    return p.select(F.col("hay_id").alias("doc_id"), F.col("needle_id").alias("item_id"))


def _tripwire_df(spark, sf):
    """The tripwire set, keyed by position; one row per value.  It is joined
    against the documents of ``sf``, so the work grows with the corpus."""
    rows = [(i, label, value) for i, (label, value) in enumerate(TRIPWIRES)]
    return spark.createDataFrame(rows, "needle_id long, label string, value string")


_TRIP_VALUES = "(VALUES " + ", ".join(f"({i}, {sql_str(lab)}, {sql_str(v)})" for i, (lab, v) in enumerate(TRIPWIRES)) + \
    ") AS t(needle_id, label, value)"


@register("tripwire_leaks", operators=("C18", "C19"), oracle=scrub_ctes(_secret_src()) + f"""
SELECT t.label, (SELECT count(*) FROM scrubbed s WHERE contains(s.text, t.value)) AS raw_hits,
       (SELECT count(*) FROM scrubbed s WHERE contains(s.scrubbed_text, t.value)) AS scrubbed_hits
FROM {_TRIP_VALUES}""")
def q_tripwire_leaks(spark, sf):
    """The must-be-clean invariant: tripwires present in the raw texts must be
    gone after scrubbing (values the recognizers do not cover would stay and
    be reported here)."""
    # an audit reads its texts several times: scrubbed once, not once a reading
    s = written(pii.scrub(secret_texts(spark, sf), "text", "reversible").select("doc_id", "scrubbed_text"), "scrubbed-texts")
    raw = with_secrets(load(spark, sf, "documents").select("doc_id", "text"))
    texts = [t.select(F.struct(F.lit(kind).alias("kind"), "doc_id").alias("id"), F.col(c).alias("text")) for kind, t, c in (("raw", raw, "text"), ("scrubbed", s, "scrubbed_text"))]
    trips = _tripwire_df(spark, sf)
    pairs = L.leak_pairs(texts[0].unionByName(texts[1]), "id", "text", trips, "needle_id", "value")
    hits = pairs.groupBy("needle_id").agg(*[F.count_if(F.col("hay_id.kind") == kind).alias(f"{kind}_hits") for kind in ("raw", "scrubbed")])
    return trips.join(hits, "needle_id", "left").select("label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("raw_hits", "scrubbed_hits")])
