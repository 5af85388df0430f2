"""Replays over request histories: cache hit assignment and serving
(D13, D14), mapping staging and lifetime (A6, A7), audit write/read-back
(A3), validation (B11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilframe.operators import audit as A
from veilframe.operators import pii
from veilframe.operators import ratelimit as R
from veilframe.plans import prompt_queries as PQ
from veilframe.plans.audit_queries import _audit_sql, audit_table
from veilframe.plans.layout import spread
from veilframe.plans.pii_sql import restore_sql, scrub_ctes
from veilframe.plans.registry import register
from veilframe.session import scratch_path
from veilframe.sources.tables import load

BASE_MS = 1704067200000
STEP_MS = 60_000
TTL_MS = 3_600_000


def cache_history(spark, sf):
    """Documents replayed as requests, one a minute in doc_id order; the
    cache key is (lang, SHA-256 of the text); every tenth request fails
    upstream (status 500) and so never writes."""
    d = load(spark, sf, "documents").select("doc_id", "text", "lang")
    return d.select("doc_id", F.concat(F.col("lang"), F.lit(":"), F.sha2("text", 256)).alias("cache_key"),
                    (F.lit(BASE_MS) + F.col("doc_id") * STEP_MS).alias("t"),
                    F.when(F.col("doc_id") % 10 == 9, 500).otherwise(200).alias("status"))


def assign_hits(reqs, ttl_ms=TTL_MS):
    """A request hits when a live entry exists for its key; only a miss
    with status < 300 writes one.  Among writable requests that is exactly
    sliding-window admission with limit 1 and window = TTL (admitted = the
    miss that writes), so the admission operator does the replay.

    Every request then finds the latest write at or before it that is still
    live.  Such a write lies in the request's TTL-wide time bucket or the one
    before, so writes are copied into their own and the next bucket and
    joined on (key, bucket): no key-wide window, and the fan-out is bounded
    (consecutive writes of a key are at least one TTL apart)."""
    writable = reqs.where(F.col("status") < 300).select(F.col("cache_key").alias("rl_key"), "t", "doc_id")
    adm = R.admit(writable, "rl_key", "t", "doc_id", 1, ttl_ms)
    bucket = lambda c: ((c - F.pmod(c, F.lit(ttl_ms))) / ttl_ms).cast("long")
    writes = (adm.where(F.col("admitted"))
                 .select(F.col("rl_key").alias("cache_key"), F.col("t").alias("w_t"), F.col("doc_id").alias("w_id"))
                 .withColumn("_b", F.explode(F.array(bucket(F.col("w_t")), bucket(F.col("w_t")) + 1))))
    r = reqs.withColumn("_b", bucket(F.col("t")))
    visible = ((F.col("w_t") < F.col("t")) | ((F.col("w_t") == F.col("t")) & (F.col("w_id") <= F.col("doc_id")))) \
        & (F.col("w_t") > F.col("t") - ttl_ms)
    cand = r.join(writes, ["cache_key", "_b"], "left").withColumn(
        "_w", F.when(visible, F.struct("w_t", "w_id")))
    # grouping keys extend the join keys, so the join's partitioning is reused
    best = cand.groupBy("cache_key", "_b", "doc_id", "t", "status").agg(F.max("_w").alias("lw"))
    hit = F.col("lw").isNotNull() & (F.col("lw.w_id") != F.col("doc_id"))
    return best.select("doc_id", "cache_key", "t", "status", hit.alias("hit"),
                       F.when(hit, F.col("lw.w_id")).otherwise(F.col("doc_id")).alias("served_from"))


HISTORY_SQL = f"""r AS (
  SELECT lang || ':' || sha256(text) AS k, {BASE_MS} + doc_id * {STEP_MS} AS t, doc_id,
         CASE WHEN doc_id % 10 = 9 THEN 500 ELSE 200 END AS status,
         row_number() OVER (PARTITION BY lang || ':' || sha256(text) ORDER BY doc_id) AS rn
  FROM documents),
run(k, rn, doc_id, lw_t, lw_id, hit, served_from) AS (
  SELECT k, rn, doc_id, CASE WHEN status < 300 THEN t END, CASE WHEN status < 300 THEN doc_id END, FALSE, doc_id
  FROM r WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn, e.doc_id,
         CASE WHEN p.lw_t IS NOT NULL AND p.lw_t > e.t - {TTL_MS} THEN p.lw_t WHEN e.status < 300 THEN e.t ELSE p.lw_t END,
         CASE WHEN p.lw_t IS NOT NULL AND p.lw_t > e.t - {TTL_MS} THEN p.lw_id WHEN e.status < 300 THEN e.doc_id ELSE p.lw_id END,
         p.lw_t IS NOT NULL AND p.lw_t > e.t - {TTL_MS},
         CASE WHEN p.lw_t IS NOT NULL AND p.lw_t > e.t - {TTL_MS} THEN p.lw_id ELSE e.doc_id END
  FROM run p JOIN r e ON e.k = p.k AND e.rn = p.rn + 1)"""


@register("hit_assignment", operators=("D13",), oracle=f"""WITH RECURSIVE {HISTORY_SQL}
SELECT doc_id, hit, served_from FROM run""")
def q_hit_assignment(spark, sf):
    return assign_hits(cache_history(spark, sf)).select("doc_id", "hit", "served_from")


def _answer(served_from):
    return F.concat(F.lit("Answer for request "), served_from.cast("string"), F.lit(": <EMAIL_ADDRESS_1> <IP_ADDRESS_1>"))


@register("served", operators=("D14",),
          oracle=scrub_ctes("SELECT doc_id AS rid, text FROM documents").replace("WITH src AS", "WITH RECURSIVE src AS", 1)
          + f""",
{HISTORY_SQL},
maps AS (SELECT rid, map_from_entries(list({{'key': placeholder, 'value': v}})) AS m FROM ph GROUP BY rid),
resp AS (SELECT run.doc_id, run.hit, 'Answer for request ' || CAST(run.served_from AS VARCHAR) || ': <EMAIL_ADDRESS_1> <IP_ADDRESS_1>' AS t,
                coalesce(maps.m, MAP {{}}::MAP(VARCHAR, VARCHAR)) AS m
         FROM run LEFT JOIN maps ON maps.rid = run.doc_id)
SELECT doc_id, hit, {restore_sql('t', 'm')} AS served_text FROM resp""")
def q_served(spark, sf):
    """A hit serves the cached answer of the request that wrote it, a
    miss the upstream answer; either way placeholders are restored with the
    *current* request's mapping, and the stored form stays placeholder-only
    (quirk Q5 fixed)."""
    hits = assign_hits(cache_history(spark, sf)).select("doc_id", "hit", "served_from")
    maps = pii.scrub(spread(load(spark, sf, "documents").select("doc_id", "text")), "text").select("doc_id", "mapping")
    j = hits.join(maps, "doc_id", "left")
    return j.select("doc_id", "hit", pii.restore(_answer(F.col("served_from")), F.col("mapping")).alias("served_text"))


# --- mapping staging (A6) and lifetime (A7) --------------------------------
PART_MAPS_SQL = """, pmap AS (
  SELECT rid // 1000 AS conv_id, (rid % 1000) // 10 AS field_ord, rid % 10 AS part_ord,
         string_agg(placeholder || '=' || v, chr(1) ORDER BY placeholder || '=' || v) AS mapping_text
  FROM ph GROUP BY rid)"""


def _part_maps_sql(body: str) -> str:
    return scrub_ctes(PQ.SCRUB_SRC).replace("WITH src AS", f"WITH {PQ.CONV_SQL},\nsrc AS", 1) + PART_MAPS_SQL + body


def _part_maps(spark, sf):
    parts = PQ._parts(spark, sf).where(F.col("scrubbable"))
    s = pii.scrub(parts, "text", "reversible")
    return s.where(F.size("mapping") > 0).select("conv_id", "field_ord", "part_ord",
                                                 pii.mapping_string(F.col("mapping")).alias("mapping_text"))


@register("stage_mapping", operators=("A6",), oracle=_part_maps_sql("""
SELECT conv_id, arg_max(field_ord, field_ord * 10 + part_ord)::INTEGER AS field_ord,
       arg_max(part_ord, field_ord * 10 + part_ord)::INTEGER AS part_ord,
       arg_max(mapping_text, field_ord * 10 + part_ord) AS mapping_text
FROM pmap GROUP BY conv_id"""))
def q_stage_mapping(spark, sf):
    """Each scrubbed part stages its mapping under the request id; a later
    stage replaces the whole mapping, an empty one writes nothing."""
    m = _part_maps(spark, sf)
    best = m.groupBy("conv_id").agg(F.max_by(F.struct("field_ord", "part_ord", "mapping_text"),
                                             F.struct("field_ord", "part_ord")).alias("b"))
    return best.select("conv_id", F.col("b.field_ord").alias("field_ord"), F.col("b.part_ord").alias("part_ord"),
                       F.col("b.mapping_text").alias("mapping_text"))


MAP_TTL_S = 300


@register("live_mapping", operators=("A7",), oracle=_part_maps_sql(f"""
SELECT conv_id, field_ord::INTEGER AS field_ord, part_ord::INTEGER AS part_ord FROM pmap
WHERE conv_id * 60 + field_ord * 100 + part_ord + {MAP_TTL_S} > conv_id * 60 + 400 AND conv_id % 4 <> 0"""))
def q_live_mapping(spark, sf):
    """Mappings staged at conv*60 + field*100 + part seconds live 300 s; read
    at conv*60 + 400 s; requests that already finished (conv % 4 = 0) have
    dropped theirs."""
    m = _part_maps(spark, sf)
    staged = F.col("conv_id") * 60 + F.col("field_ord") * 100 + F.col("part_ord")
    live = m.where(staged + MAP_TTL_S > F.col("conv_id") * 60 + 400)
    finished = m.select("conv_id").distinct().where(F.col("conv_id") % 4 == 0)
    return live.join(finished, "conv_id", "left_anti").select("conv_id", "field_ord", "part_ord")


# --- A3: audit append and read-back ----------------------------------------
AUDIT_ROUNDTRIP_SQL = _audit_sql("""
SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS requests, round(sum(estimated_cost_usd), 4) AS cost_usd
FROM audit GROUP BY ALL""")


@register("audit_roundtrip", operators=("A3", "A2"), oracle=AUDIT_ROUNDTRIP_SQL)
def q_audit_roundtrip(spark, sf):
    """Append the audit table partitioned by day into the shared folder, read
    it back whole with its declared schema."""
    a = audit_table(spark, sf).drop("status", "is_stream")
    path = scratch_path(spark, f"audit-{uuid.uuid4().hex}")
    col = A.append_audit(a, path, granularity="month")
    back = spark.read.schema(a.schema.add(col, "string")).parquet(path)
    return back.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.sum("estimated_cost_usd"), 4).alias("cost_usd"))


# --- B11: validation ---------------------------------------------------------
@register("validation_violations", operators=("B11",), oracle="""
SELECT 'threshold_out_of_range' AS violation, CAST(event_id AS VARCHAR) AS detail FROM events
WHERE value / 100 < 0 OR value / 100 > 1
UNION ALL SELECT 'negative_tokens', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 2048 < 0
UNION ALL SELECT 'bad_key_name', CAST(c_custkey AS VARCHAR) FROM customer WHERE length(c_name) < 1 OR length(c_name) > 255""")
def q_validation_violations(spark, sf):
    """Threshold proposals (event value / 100) must lie in [0, 1]; token
    counts must be >= 0; key names 1-255 characters."""
    from veilframe.sources import domain as D

    ev = load(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("p"))
    bad_t = ev.where((F.col("p") < 0) | (F.col("p") > 1)).select(
        F.lit("threshold_out_of_range").alias("violation"), F.col("event_id").cast("string").alias("detail"))
    req = D.requests(spark, sf)
    bad_tok = req.where((F.col("prompt_tokens") < 0) | (F.col("completion_tokens") < 0)).select(
        F.lit("negative_tokens").alias("violation"), F.col("request_id").cast("string").alias("detail"))
    keys = D.api_keys(spark, sf)
    bad_name = keys.where((F.length("name") < 1) | (F.length("name") > 255)).select(
        F.lit("bad_key_name").alias("violation"), F.col("key_id").cast("string").alias("detail"))
    return bad_t.unionByName(bad_tok).unionByName(bad_name)
