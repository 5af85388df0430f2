"""Semantic-cache queries over ``embeddings`` and ``nation`` (A4, A5, A9,
B9, B10, D1-D12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilframe.operators import cache as C
from veilframe.operators import ivf
from veilframe.session import scratch_path
from veilframe.sources import cache_table as CT
from veilframe.plans.registry import register
from veilframe.sources import domain as D
from veilframe.sources.tables import load

ORG_MOD = 3
BASE_MS = 1704067200000  # 2024-01-01 00:00:00 UTC
QUERY_DELAY_MS = 30 * 60 * 1000
PERTURB = 0.04

_MODELS = {p: [m for q, m in D.PREWARMED if q == p] for p in D.PROVIDERS}


def _block_cols(label):
    prov_idx = (label / 3).cast("int") % 3
    provider = F.element_at(F.array(*[F.lit(p) for p in D.PROVIDERS]), (prov_idx + 1).cast("int"))
    first = F.element_at(F.array(*[F.lit(_MODELS[p][0]) for p in D.PROVIDERS]), (prov_idx + 1).cast("int"))
    second = F.element_at(F.array(*[F.lit(_MODELS[p][1]) for p in D.PROVIDERS]), (prov_idx + 1).cast("int"))
    return [(label % ORG_MOD).cast("long").alias("org_id"), provider.alias("provider"),
            F.when(label % 2 == 0, first).otherwise(second).alias("model")]


def _sql_arr(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


BLOCK_SQL = (f"(label % {ORG_MOD})::BIGINT AS org_id, {_sql_arr(D.PROVIDERS)}[(label // 3) % 3 + 1] AS provider, "
             f"CASE WHEN label % 2 = 0 THEN {_sql_arr([_MODELS[p][0] for p in D.PROVIDERS])}[(label // 3) % 3 + 1] "
             f"ELSE {_sql_arr([_MODELS[p][1] for p in D.PROVIDERS])}[(label // 3) % 3 + 1] END AS model")


def cache_entries(spark, sf):
    e = load(spark, sf, "embeddings")
    created = F.lit(BASE_MS) + F.col("vec_id") * 60000
    ttl = (F.col("vec_id") % 3) * 3600
    return e.select(F.col("vec_id").alias("e_id"), *_block_cols(F.col("label")), F.col("embedding").alias("e_vec"),
                    C.prompt_hash(F.col("vec_id").cast("string")).alias("prompt_hash"),
                    created.alias("e_created_ms"), ttl.cast("int").alias("ttl_seconds"),
                    (created + ttl * 1000).alias("e_expires_ms"))


ENTRIES_SQL = f"""entries AS (
  SELECT vec_id AS e_id, {BLOCK_SQL}, embedding AS e_vec, sha256(CAST(vec_id AS VARCHAR)) AS prompt_hash,
         {BASE_MS} + vec_id * 60000 AS e_created_ms, ((vec_id % 3) * 3600)::INTEGER AS ttl_seconds,
         {BASE_MS} + vec_id * 60000 + (vec_id % 3) * 3600 * 1000 AS e_expires_ms
  FROM embeddings)"""


def cache_queries(spark, sf):
    """Two probes per vector, issued 30 min after the vector was cached: an
    exact copy (kind 0) and a copy perturbed by 0.04 sin(i + id) per component
    and renormalised (kind 1).  Org policy decides threshold and whether the
    lookup runs."""
    e = load(spark, sf, "embeddings")
    pert = F.transform("embedding", lambda x, i: x.cast("double") + PERTURB * F.sin(i + F.col("vec_id")))
    kinds = F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")
    base = C.with_normalized(e.withColumn("_pert", pert), "_pert", "_pert_unit").select(
        "vec_id", "label", "embedding", "_pert_unit", kinds)
    vec = F.when(F.col("kind") == 0, F.transform("embedding", lambda x: x.cast("double"))).otherwise(F.col("_pert_unit"))
    q = base.select((F.col("vec_id") * 2 + F.col("kind")).alias("q_id"), *_block_cols(F.col("label")),
                    vec.alias("q_vec"),
                    C.prompt_hash(F.when(F.col("kind") == 0, F.col("vec_id").cast("string"))
                                   .otherwise(F.concat(F.col("vec_id").cast("string"), F.lit("~")))).alias("prompt_hash"),
                    (F.lit(BASE_MS) + F.col("vec_id") * 60000 + QUERY_DELAY_MS).alias("q_ts_ms"))
    pol = C.with_effective_cache_policy(D.orgs(spark, sf)).select(
        "org_id", F.col("effective_threshold").alias("threshold"), "effective_ttl")
    return q.join(F.broadcast(pol), "org_id", "inner").withColumn("is_stream", F.lit(False))


QUERIES_SQL = f"""pol AS (
  SELECT n_nationkey::BIGINT AS org_id,
         CASE WHEN n_nationkey % 4 IN (0, 1) THEN 0.92 ELSE 0.40 END AS threshold,
         CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 86400 END AS effective_ttl
  FROM nation),
qbase AS (
  SELECT vec_id * 2 + kind AS q_id, {BLOCK_SQL},
         CASE WHEN kind = 0 THEN CAST(embedding AS DOUBLE[])
              ELSE list_transform(p, lambda x: x / sqrt(list_sum(list_transform(p, lambda y: y * y)))) END AS q_vec,
         sha256(CASE WHEN kind = 0 THEN CAST(vec_id AS VARCHAR) ELSE CAST(vec_id AS VARCHAR) || '~' END) AS prompt_hash,
         {BASE_MS} + vec_id * 60000 + {QUERY_DELAY_MS} AS q_ts_ms
  FROM (SELECT *, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + {PERTURB} * sin(i - 1 + vec_id)) AS p
        FROM embeddings, (SELECT unnest([0, 1]) AS kind))),
queries AS (SELECT qbase.*, pol.threshold, pol.effective_ttl FROM qbase JOIN pol USING (org_id)),
scored AS (
  SELECT q.q_id, e.e_id, list_cosine_similarity(q.q_vec, CAST(e.e_vec AS DOUBLE[])) AS sim, e.e_created_ms
  FROM queries q JOIN entries e USING (org_id, provider, model)
  WHERE q.effective_ttl > 0 AND e.e_created_ms <= q.q_ts_ms AND q.q_ts_ms < e.e_expires_ms),
best AS (
  SELECT q_id, arg_max(e_id, (sim, e_created_ms, -e_id)) AS entry_id, max(sim) AS sim FROM scored GROUP BY q_id),
lookup AS (
  SELECT q.q_id, q.org_id, q.provider, q.model,
         CASE WHEN q.effective_ttl <= 0 THEN 'skipped' WHEN b.sim >= q.threshold THEN 'hit' ELSE 'miss' END AS status,
         CASE WHEN b.sim >= q.threshold AND q.effective_ttl > 0 THEN b.entry_id END AS entry_id,
         CASE WHEN b.sim >= q.threshold AND q.effective_ttl > 0 THEN round(b.sim, 6) END AS similarity
  FROM queries q LEFT JOIN best b USING (q_id))"""


def lookups(spark, sf):
    q = cache_queries(spark, sf)
    eligible = C.cacheable(q)
    best = C.nearest_entries(eligible.select("q_id", "org_id", "provider", "model", "q_vec", "q_ts_ms", "threshold"),
                             cache_entries(spark, sf))
    out = q.join(best.withColumnRenamed("query_id", "q_id"), "q_id", "left")
    status = (F.when(F.col("effective_ttl") <= 0, "skipped")
               .when(F.col("entry_id").isNotNull(), "hit").otherwise("miss"))
    return out.select("q_id", "org_id", "provider", "model", status.alias("status"), "entry_id",
                      F.round("similarity", 6).alias("similarity"))


def _cache_sql(body):
    return f"WITH {ENTRIES_SQL},\n{QUERIES_SQL}\n{body}"


@register("cache_lookup", operators=("D5", "D6", "D7", "B9", "B10"), oracle=_cache_sql(
    "SELECT q_id, org_id, provider, model, status, entry_id, similarity FROM lookup"))
def q_cache_lookup(spark, sf):
    return lookups(spark, sf)


@register("cache_stats", operators=("D12",), oracle=_cache_sql("""
SELECT provider, model, count(*) FILTER (WHERE status = 'hit') AS hits, count(*) FILTER (WHERE status = 'miss') AS misses
FROM lookup WHERE status <> 'skipped' GROUP BY provider, model"""))
def q_cache_stats(spark, sf):
    return C.cache_stats(lookups(spark, sf))


@register("cache_isolation_violations", operators=("D8",), oracle="SELECT 1::BIGINT AS q_id WHERE FALSE")
def q_cache_isolation_violations(spark, sf):
    hits = lookups(spark, sf).where(F.col("status") == "hit")
    e = cache_entries(spark, sf).select(F.col("e_id").alias("entry_id"), F.col("org_id").alias("e_org"),
                                        F.col("provider").alias("e_provider"), F.col("model").alias("e_model"))
    j = hits.join(e, "entry_id", "inner")
    return j.where((F.col("org_id") != F.col("e_org")) | (F.col("provider") != F.col("e_provider"))
                   | (F.col("model") != F.col("e_model"))).select("q_id")


@register("effective_policy", operators=("B9",), oracle=D.with_views("""
SELECT org_id, CASE WHEN cache_similarity_threshold IS NULL OR cache_similarity_threshold = 0 THEN 0.92
                    ELSE cache_similarity_threshold END AS effective_threshold,
       coalesce(cache_ttl_seconds, 86400) AS effective_ttl
FROM orgs""", "orgs"))
def q_effective_policy(spark, sf):
    return C.with_effective_cache_policy(D.orgs(spark, sf)).select("org_id", "effective_threshold", "effective_ttl")


@register("exact_hash_hits", operators=("D1", "D11"), oracle=_cache_sql("""
SELECT q.q_id, arg_max(e.e_id, (e.e_created_ms, -e.e_id)) AS entry_id
FROM queries q JOIN entries e USING (org_id, provider, model, prompt_hash)
WHERE e.e_created_ms <= q.q_ts_ms AND q.q_ts_ms < e.e_expires_ms GROUP BY q.q_id"""))
def q_exact_hash_hits(spark, sf):
    return C.exact_hash_hits(cache_queries(spark, sf), cache_entries(spark, sf))


@register("vector_quantize", operators=("D2",), oracle="""
SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 10000000.0 + 0.5) / 10000000.0) AS q
FROM embeddings""")
def q_vector_quantize(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", C.quantize(F.col("embedding"), 7).alias("q"))


@register("vector_normalize", operators=("D3",), oracle="""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm_before,
       round(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) [1], 6) AS first_unit
FROM embeddings""")
def q_vector_normalize(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", F.round(C.norm(F.col("embedding")), 6).alias("norm_before"),
                    F.round(F.element_at(C.normalize(F.col("embedding")), 1), 6).alias("first_unit"))


SIMILAR_THRESHOLD = 0.45


@register("similar_pairs", operators=("D9",), oracle=f"""
SELECT a.vec_id AS a_id, b.vec_id AS b_id,
       round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {SIMILAR_THRESHOLD}""")
def q_similar_pairs(spark, sf):
    e = load(spark, sf, "embeddings")
    p = C.similar_pairs(e, "vec_id", "embedding", ["label"], SIMILAR_THRESHOLD)
    return p.select("a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@register("cache_appends", operators=("A4",), oracle=f"""WITH {ENTRIES_SQL}
SELECT org_id, provider, model, count(*) AS appended FROM entries WHERE ttl_seconds > 0 GROUP BY ALL""")
def q_cache_appends(spark, sf):
    return C.append_cache(cache_entries(spark, sf)).groupBy("org_id", "provider", "model").agg(
        F.count(F.lit(1)).alias("appended"))


COMPACT_AS_OF_MS = BASE_MS + 300 * 60000


@register("cache_compaction", operators=("A9", "D7"), oracle=f"""WITH {ENTRIES_SQL}
SELECT org_id, provider, model, count(*) AS kept FROM entries
WHERE ttl_seconds > 0 AND e_expires_ms > {COMPACT_AS_OF_MS} GROUP BY ALL""")
def q_cache_compaction(spark, sf):
    kept = C.live(C.append_cache(cache_entries(spark, sf)).withColumnRenamed("e_expires_ms", "expires_at"),
                  F.lit(COMPACT_AS_OF_MS))
    return kept.groupBy("org_id", "provider", "model").agg(F.count(F.lit(1)).alias("kept"))


@register("cache_table", operators=("A4", "A5", "A9"), oracle=f"""WITH {ENTRIES_SQL}
SELECT provider, model, CAST(e_id % 3 AS VARCHAR) AS batch, count(*) AS kept, min(e_id) AS first_id FROM entries
WHERE ttl_seconds > 0 AND e_expires_ms > {COMPACT_AS_OF_MS} GROUP BY ALL""")
def q_cache_table(spark, sf):
    """Entries appended in three batches, one of them twice (a retry), then purged as of a time."""
    path = scratch_path(spark, f"cache-table-{uuid.uuid4().hex}")
    e = cache_entries(spark, sf)
    for batch in (0, 1, 1, 2):
        CT.append(e.where(F.col("e_id") % 3 == batch), path, str(batch))
    CT.purge(spark, path, F.lit(COMPACT_AS_OF_MS))
    return CT.read(spark, path).groupBy("provider", "model", "batch").agg(F.count(F.lit(1)).alias("kept"), F.min("e_id").alias("first_id"))


@register("cache_partitions", operators=("A5",), oracle=D.with_views(f"""
SELECT provider, model, lower(translate(provider, '-.:', '___')) AS provider_part,
       CASE WHEN provider || '/' || model IN ({", ".join(f"'{p}/{m}'" for p, m in D.PREWARMED)})
            THEN lower(translate(model, '-.:', '___')) ELSE 'default' END AS model_part,
       count(*) AS n
FROM requests GROUP BY ALL""", "requests"))
def q_cache_partitions(spark, sf):
    r = D.requests(spark, sf).select("provider", "model")
    return C.with_partition_cols(r).groupBy("provider", "model", "provider_part", "model_part").agg(
        F.count(F.lit(1)).alias("n"))


@register("prompt_hashes", operators=("D1",), oracle="""
SELECT doc_id, sha256(text) AS prompt_hash FROM documents""")
def q_prompt_hashes(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", C.prompt_hash(F.col("text")).alias("prompt_hash"))


@register("cache_lookup_lsh", operators=("D10",))
def q_cache_lookup_lsh(spark, sf):
    """Approximate twin of ``cache_lookup`` for hits at cosine >= 0.92 over every cacheable query:
    each visits its two nearest cells of the inverted file.  (Random projection buckets,
    ``cache.lsh_lookup``, hold most of a block each and prune next to nothing here.)  Rows only,
    recall and the share of pairs scored are checked in tests."""
    q = C.cacheable(cache_queries(spark, sf)).withColumn("threshold", F.greatest("threshold", F.lit(0.92)))
    r = ivf.lookup(q, cache_entries(spark, sf), probes=2).where("entry_id is not null")
    return r.select("q_id", "entry_id", F.round("similarity", 6).alias("similarity"))


@register("cache_lookup_cells", operators=("D6", "D10"), oracle=_cache_sql(
    "SELECT q_id, entry_id, similarity FROM lookup WHERE status = 'hit'"))
def q_cache_lookup_cells(spark, sf):
    """``cache_lookup`` through the inverted file, exact: cells are closed by the triangle
    inequality only.  ``ivf.lookup(probes=...)`` is the approximate form; its recall is tested."""
    q = C.cacheable(cache_queries(spark, sf))
    found = ivf.lookup(q, cache_entries(spark, sf)).where("entry_id is not null")
    return found.select("q_id", "entry_id", F.round("similarity", 6).alias("similarity"))


@register("similar_pairs_cells", operators=("D9",), oracle=f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, min(vec_id) OVER (PARTITION BY label, embedding) AS first FROM embeddings)
SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, FALSE AS copies
FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND a.vec_id = a.first AND b.vec_id = b.first
WHERE list_cosine_similarity(a.v, b.v) >= {SIMILAR_THRESHOLD}
UNION ALL SELECT first, vec_id, 1.0, TRUE FROM v WHERE vec_id <> first""")
def q_similar_pairs_cells(spark, sf):
    """Similar vectors of one label through the inverted file, copies linked once."""
    e = load(spark, sf, "embeddings")
    p = ivf.similar_pairs(e, "vec_id", "embedding", ["label"], SIMILAR_THRESHOLD)
    return p.select("a_id", "b_id", F.round("similarity", 6).alias("similarity"), "copies")


NEAR_DUP_THRESHOLD = 0.9


@register("featurized_pairs", operators=("D4", "D9"))
def q_featurized_pairs(spark, sf):
    """Near-duplicate documents within a language: hashed TF-IDF vectors,
    then the blocked similarity join at cosine >= 0.9.  The hashing is
    Spark's own, so the check is rows-only (exact copies must all appear;
    see tests)."""
    from veilframe.plans.layout import spread

    d = spread(load(spark, sf, "documents").select("doc_id", "lang", "text"))
    f = C.featurize(d, "text", "vec")
    p = C.similar_pairs(f, "doc_id", "vec", ["lang"], NEAR_DUP_THRESHOLD)
    return p.select(F.col("a_id").alias("doc_a"), F.col("b_id").alias("doc_b"), F.round("similarity", 6).alias("similarity"))
