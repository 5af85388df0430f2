"""Key lifecycle queries over customer / nation / orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import keys as K
from veilframe.plans.registry import register
from veilframe.sources import domain as D
from veilframe.sources.tables import load

AS_OF = "1998-06-01 00:00:00"
SUCCESSOR_OFFSET = 1_000_000_000
TS_FMT = "yyyy-MM-dd HH:mm:ss"
TS_SQL = "%Y-%m-%d %H:%M:%S"


@register("auth_outcomes", operators=("F1", "F2"), oracle=D.with_views(f"""
SELECT a.attempt_id,
  CASE WHEN a.presented IS NULL OR a.presented = '' THEN 'missing'
       WHEN NOT starts_with(a.presented, '{D.KEY_PREFIX}') OR length(a.presented) < 8 THEN 'malformed'
       WHEN k.key_id IS NULL THEN 'unknown'
       WHEN k.revoked_at IS NOT NULL AND k.revoked_at <= a.ts THEN 'revoked'
       WHEN k.grace_expires_at IS NOT NULL AND k.grace_expires_at <= a.ts THEN 'grace_expired'
       ELSE 'ok' END AS outcome,
  k.key_id AS matched_key_id
FROM auth_attempts a LEFT JOIN api_keys k
  ON starts_with(a.presented, '{D.KEY_PREFIX}') AND length(a.presented) >= 8
 AND k.key_suffix = right(a.presented, 4) AND k.key_hash = sha256('salt' || a.presented)""",
                                                                           "api_keys", "auth_attempts"))
def q_auth_outcomes(spark, sf):
    m = K.auth_outcome(K.match_keys(D.auth_attempts(spark, sf), D.api_keys(spark, sf)))
    return m.select("attempt_id", "outcome", "matched_key_id")


@register("auth_failures", operators=("F7",), oracle=D.with_views(f"""
SELECT outcome AS reason, count(*) AS n FROM (
SELECT CASE WHEN a.presented IS NULL OR a.presented = '' THEN 'missing'
       WHEN NOT starts_with(a.presented, '{D.KEY_PREFIX}') OR length(a.presented) < 8 THEN 'malformed'
       WHEN k.key_id IS NULL THEN 'unknown'
       WHEN k.revoked_at IS NOT NULL AND k.revoked_at <= a.ts THEN 'revoked'
       WHEN k.grace_expires_at IS NOT NULL AND k.grace_expires_at <= a.ts THEN 'grace_expired'
       ELSE 'ok' END AS outcome
FROM auth_attempts a LEFT JOIN api_keys k
  ON starts_with(a.presented, '{D.KEY_PREFIX}') AND length(a.presented) >= 8
 AND k.key_suffix = right(a.presented, 4) AND k.key_hash = sha256('salt' || a.presented))
WHERE outcome <> 'ok' GROUP BY outcome""", "api_keys", "auth_attempts"))
def q_auth_failures(spark, sf):
    m = K.auth_outcome(K.match_keys(D.auth_attempts(spark, sf), D.api_keys(spark, sf)))
    return m.where(F.col("outcome") != "ok").groupBy(F.col("outcome").alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


@register("key_status", operators=("F3",), oracle=D.with_views(f"""
SELECT key_id,
  CASE WHEN revoked_at IS NOT NULL AND revoked_at <= TIMESTAMP '{AS_OF}' THEN 'revoked'
       WHEN grace_expires_at IS NOT NULL AND grace_expires_at <= TIMESTAMP '{AS_OF}' THEN 'grace_expired'
       WHEN grace_expires_at IS NOT NULL THEN 'in_grace' ELSE 'active' END AS status
FROM api_keys""", "api_keys"))
def q_key_status(spark, sf):
    return K.key_status(D.api_keys(spark, sf), F.lit(AS_OF).cast("timestamp_ntz")).select("key_id", "status")


def _rotation_events(spark, sf):
    """One rotation request for every key (a key divisible by 13 already has a
    grace expiry), from a foreign org for every 50th."""
    k = D.api_keys(spark, sf)
    return k.select(
        "key_id", F.when(F.col("key_id") % 50 == 4, F.col("org_id") + 1).otherwise(F.col("org_id")).alias("org_id"),
        F.lit("1997-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))


@register("rotations", operators=("F4",), oracle=D.with_views(f"""
SELECT e.key_id,
  CASE WHEN k.org_id IS NULL OR k.org_id <> e.org_id THEN 404 WHEN k.grace_expires_at IS NOT NULL THEN 409 ELSE 201 END AS status,
  CASE WHEN k.org_id = e.org_id AND k.grace_expires_at IS NULL THEN e.key_id + {SUCCESSOR_OFFSET} END AS new_key_id,
  CASE WHEN k.org_id = e.org_id AND k.grace_expires_at IS NULL THEN k.name || ' (rotated)' END AS new_name,
  CASE WHEN k.org_id = e.org_id AND k.grace_expires_at IS NULL THEN k.rate_limit_per_hour END AS new_rate_limit,
  CASE WHEN k.org_id = e.org_id AND k.grace_expires_at IS NULL THEN strftime(e.ts + INTERVAL 24 HOUR, '{TS_SQL}') END AS grace_expires_at
FROM (SELECT key_id, CASE WHEN key_id % 50 = 4 THEN org_id + 1 ELSE org_id END AS org_id,
             TIMESTAMP '1997-01-01 00:00:00' AS ts FROM api_keys) e
LEFT JOIN api_keys k USING (key_id)""", "api_keys"))
def q_rotations(spark, sf):
    r = K.apply_rotations(D.api_keys(spark, sf), _rotation_events(spark, sf), SUCCESSOR_OFFSET)
    return r.withColumn("grace_expires_at", F.date_format("grace_expires_at", TS_FMT))


@register("revocations", operators=("F5",), oracle=D.with_views(f"""
SELECT key_id, max(CASE WHEN status = 204 THEN ts END) AS revoked_at_new, count(*) AS n_events,
       count(*) FILTER (WHERE status = 404) AS n_not_found
FROM (SELECT e.key_id, e.ts, CASE WHEN k.org_id IS NOT NULL AND k.org_id = e.org_id THEN 204 ELSE 404 END AS status
      FROM (SELECT o_custkey AS key_id, o_orderkey % 25 AS org_id, strftime(o_orderdate, '{TS_SQL}') AS ts
            FROM orders) e LEFT JOIN api_keys k USING (key_id))
GROUP BY key_id""", "api_keys"))
def q_revocations(spark, sf):
    o = load(spark, sf, "orders")
    ev = o.select(F.col("o_custkey").alias("key_id"), (F.col("o_orderkey") % 25).alias("org_id"),
                  F.date_format("o_orderdate", TS_FMT).alias("ts"))
    r = K.apply_revocations(D.api_keys(spark, sf), ev)
    return r.groupBy("key_id").agg(
        F.max(F.when(F.col("status") == 204, F.col("ts"))).alias("revoked_at_new"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("status") == 404).alias("n_not_found"))


def _key_events(spark, sf):
    """Every order is an event on its customer's key: each third a rotation, the others revocations; each
    fifth comes from another org."""
    o = load(spark, sf, "orders").join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    k = F.col("o_orderkey")
    fresh = F.sha2(F.concat(F.lit("new"), k.cast("string")), 256)
    return o.select(k.alias("event_id"), F.when(k % 3 == 0, "rotate").otherwise("revoke").alias("kind"), F.col("o_custkey").alias("key_id"),
                    (F.col("c_nationkey") + F.when(k % 5 == 0, 1).otherwise(0)).cast("long").alias("org_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
                    (k + SUCCESSOR_OFFSET).alias("new_key_id"), fresh.alias("new_hash"), F.right(fresh, F.lit(4)).alias("new_suffix"))


KEY_EVENTS_SQL = f"""e AS (
  SELECT o_orderkey AS event_id, o_custkey AS key_id, o_orderdate AS ts, o_orderkey % 3 = 0 AS rotate, o_orderkey % 5 <> 0 AS mine,
         sha256('new' || CAST(o_orderkey AS VARCHAR)) AS fresh FROM orders JOIN customer ON c_custkey = o_custkey),
f AS (SELECT key_id, arg_min(event_id, (ts, event_id)) FILTER (WHERE rotate) AS rot, max(ts) FILTER (WHERE NOT rotate) AS rev FROM e WHERE mine GROUP BY key_id),
g AS (SELECT k.*, f.rev, r.event_id, r.ts, r.fresh FROM api_keys k LEFT JOIN f USING (key_id)
      LEFT JOIN e r ON r.event_id = f.rot AND k.grace_expires_at IS NULL)"""


@register("key_table", operators=("F4", "F5"), oracle=D.with_views(f""", {KEY_EVENTS_SQL}
SELECT key_id, org_id, name, key_suffix, key_hash, strftime(created_at, '{TS_SQL}') AS created_at, strftime(coalesce(rev, revoked_at), '{TS_SQL}') AS revoked_at,
       strftime(coalesce(grace_expires_at, ts + INTERVAL 24 HOUR), '{TS_SQL}') AS grace_expires_at, rotated_from_id, rate_limit_per_hour FROM g
UNION ALL
SELECT event_id + {SUCCESSOR_OFFSET}, org_id, name || ' (rotated)', right(fresh, 4), fresh, strftime(ts, '{TS_SQL}'), NULL, NULL, key_id, rate_limit_per_hour
FROM g WHERE event_id IS NOT NULL""", "api_keys").replace("\n, e AS", ", e AS", 1))
def q_key_table(spark, sf):
    """The key table after every order's event."""
    table, _ = K.apply_key_events(D.api_keys(spark, sf), _key_events(spark, sf))
    for c in ("created_at", "revoked_at", "grace_expires_at"):
        table = table.withColumn(c, F.date_format(c, TS_FMT))
    return table


@register("key_event_outcomes", operators=("F4", "F5"), oracle=D.with_views(f""", {KEY_EVENTS_SQL}
SELECT e.event_id, e.key_id, CASE WHEN e.rotate THEN 'rotate' ELSE 'revoke' END AS kind,
       CASE WHEN NOT mine THEN 404 WHEN NOT rotate THEN 204 WHEN e.event_id = g.event_id THEN 201 ELSE 409 END AS status
FROM e JOIN g ON g.key_id = e.key_id""", "api_keys").replace("\n, e AS", ", e AS", 1))
def q_key_event_outcomes(spark, sf):
    return K.apply_key_events(D.api_keys(spark, sf), _key_events(spark, sf))[1]


@register("lineage", operators=("F6",), oracle=D.with_views("""
SELECT key_id, root_id, depth FROM (
WITH RECURSIVE chain(key_id, root_id, depth) AS (
  SELECT key_id, key_id, 0 FROM api_keys k
  WHERE rotated_from_id IS NULL OR NOT EXISTS (SELECT 1 FROM api_keys p WHERE p.key_id = k.rotated_from_id)
  UNION ALL
  SELECT k.key_id, c.root_id, c.depth + 1 FROM api_keys k JOIN chain c ON k.rotated_from_id = c.key_id)
SELECT * FROM chain)""", "api_keys"))
def q_lineage(spark, sf):
    return K.key_lineage(spark, D.api_keys(spark, sf))


@register("key_list", operators=("B13",), oracle=D.with_views(f"""
SELECT key_id, org_id, name, key_suffix, rate_limit_per_hour, rotated_from_id,
       strftime(created_at, '{TS_SQL}') AS created_at, strftime(revoked_at, '{TS_SQL}') AS revoked_at,
       strftime(grace_expires_at, '{TS_SQL}') AS grace_expires_at
FROM api_keys WHERE org_id = 7""", "api_keys"))
def q_key_list(spark, sf):
    out = K.list_keys(D.api_keys(spark, sf), 7)
    for c in ("created_at", "revoked_at", "grace_expires_at"):
        out = out.withColumn(c, F.date_format(c, TS_FMT))
    return out


@register("rate_limits", operators=("E5",), oracle=D.with_views("""
SELECT key_id, CASE WHEN rate_limit_per_hour IS NULL OR rate_limit_per_hour = 0 THEN 1000
                    ELSE rate_limit_per_hour END AS effective_limit FROM api_keys""", "api_keys"))
def q_rate_limits(spark, sf):
    return K.with_limit(D.api_keys(spark, sf)).select("key_id", "effective_limit")


@register("integrity", operators=("F8",), oracle=D.with_views("""
SELECT 'duplicate_key_hash' AS violation, key_hash AS detail FROM api_keys GROUP BY key_hash HAVING count(*) > 1
UNION ALL
SELECT 'orphan_key', CAST(key_id AS VARCHAR) FROM api_keys k WHERE NOT EXISTS (SELECT 1 FROM orgs o WHERE o.org_id = k.org_id)
""", "orgs", "api_keys"))
def q_integrity(spark, sf):
    return K.integrity_violations(D.api_keys(spark, sf), D.orgs(spark, sf))


@register("cascade", operators=("F9",), oracle=D.with_views("""
SELECT 'api_keys' AS table_name, count(*) AS remaining FROM api_keys WHERE org_id NOT IN (3, 7)
UNION ALL SELECT 'requests', count(*) FROM requests WHERE org_id NOT IN (3, 7)""", "api_keys", "requests"))
def q_cascade(spark, sf):
    doomed = D.orgs(spark, sf).where(F.col("org_id").isin(3, 7))
    left = K.cascade_delete(doomed, {"api_keys": D.api_keys(spark, sf), "requests": D.requests(spark, sf)})
    parts = [df.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(n).alias("table_name"), "remaining")
             for n, df in left.items()]
    return parts[0].unionByName(parts[1])
