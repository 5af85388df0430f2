"""API-key lifecycle as slowly changing table operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.session import written
from veilframe.sources.domain import KEY_PREFIX, SUFFIX_LEN, key_hash_of

DEFAULT_RATE_LIMIT = 1000  # fixed value: default requests per hour
ROTATION_GRACE_HOURS = 24  # fixed value: grace window of a rotated key


def match_keys(attempts: DataFrame, keys: DataFrame, token_col: str = "presented") -> DataFrame:
    """equi-join on (suffix, salted hash).  The suffix narrows candidates
    as the reference's suffix lookup does; the hash equality replaces the
    per-candidate verify.  Left join keeps unmatched attempts."""
    tok = F.col(token_col)
    malformed = tok.isNull() | ~tok.startswith(KEY_PREFIX) | (F.length(tok) < len(KEY_PREFIX) + SUFFIX_LEN)
    a = attempts.withColumn("_malformed", malformed).withColumn(
        "_suffix", F.when(~malformed, F.substring(tok, -SUFFIX_LEN, SUFFIX_LEN))).withColumn(
        "_hash", F.when(~malformed, key_hash_of(tok)))
    k = keys.select(F.col("key_id").alias("matched_key_id"), F.col("key_suffix").alias("_k_suffix"),
                    F.col("key_hash").alias("_k_hash"), F.col("org_id").alias("matched_org_id"),
                    F.col("revoked_at").alias("_revoked_at"), F.col("grace_expires_at").alias("_grace"))
    # missing and malformed tokens match no key; a salt of their own keeps them from meeting in one task
    salt = F.when(malformed, F.xxhash64(*attempts.columns)).otherwise(F.lit(0))
    found = a.withColumn("_salt", salt).join(k.withColumn("_k_salt", F.lit(0).cast("long")), (
        F.coalesce("_suffix", F.lit("")) == F.col("_k_suffix")) & (F.coalesce("_hash", F.lit("")) == F.col("_k_hash")) & (F.col("_salt") == F.col("_k_salt")), "left")
    return found.drop("_k_suffix", "_k_hash", "_salt", "_k_salt")


def auth_outcome(matched: DataFrame, token_col: str = "presented", ts_col: str = "ts") -> DataFrame:
    """first failing check in the order missing, malformed, unknown,
    revoked (revoked_at <= t), grace_expired (grace_expires_at <= t), else ok."""
    tok, ts = F.col(token_col), F.col(ts_col)
    outcome = (F.when(tok.isNull() | (tok == ""), "missing")
                .when(F.col("_malformed"), "malformed")
                .when(F.col("matched_key_id").isNull(), "unknown")
                .when(F.col("_revoked_at").isNotNull() & (F.col("_revoked_at") <= ts), "revoked")
                .when(F.col("_grace").isNotNull() & (F.col("_grace") <= ts), "grace_expired")
                .otherwise("ok"))
    return matched.withColumn("outcome", outcome).drop("_malformed", "_suffix", "_hash", "_revoked_at", "_grace")


def key_status(keys: DataFrame, as_of: Column) -> DataFrame:
    """active / in_grace / grace_expired / revoked at ``as_of``."""
    st = (F.when(F.col("revoked_at").isNotNull() & (F.col("revoked_at") <= as_of), "revoked")
           .when(F.col("grace_expires_at").isNotNull() & (F.col("grace_expires_at") <= as_of), "grace_expired")
           .when(F.col("grace_expires_at").isNotNull(), "in_grace")
           .otherwise("active"))
    return keys.withColumn("status", st)


def apply_rotations(keys: DataFrame, events: DataFrame, successor_offset: int) -> DataFrame:
    """``events(key_id, org_id, ts)``.  404 when the key is unknown or in
    another org, 409 when it already has a grace expiry or an earlier event has
    rotated it, else 201 with a successor ``"<name> (rotated)"`` and the
    predecessor's grace set to ts + 24 h.  One output row per event; of several
    valid events of a key at its earliest time one succeeds.

    The one that does is found by a minimum per key (partial aggregation, so a
    hot key is no hot task)."""
    k = keys.select("key_id", F.col("org_id").alias("_k_org"), "name", "grace_expires_at", "rate_limit_per_hour")
    j = events.join(k, "key_id", "left")
    j = j.withColumn("_event", F.struct("ts", F.monotonically_increasing_id().alias("n")))
    valid = F.col("_k_org").isNotNull() & (F.col("_k_org") == F.col("org_id"))
    j = written(j, "rotations")  # the row numbers must not change between the two reads
    first = j.where(valid).groupBy("key_id").agg(F.min("_event").alias("_first"))
    j = j.join(first, "key_id", "left")
    ok = valid & F.col("grace_expires_at").isNull() & (F.col("_event") == F.col("_first"))
    status = F.when(~F.coalesce(valid, F.lit(False)), 404).when(ok, 201).otherwise(409)
    return j.select(
        "key_id", status.alias("status"),
        F.when(ok, F.col("key_id") + successor_offset).alias("new_key_id"),
        F.when(ok, F.concat(F.col("name"), F.lit(" (rotated)"))).alias("new_name"),
        F.when(ok, F.col("rate_limit_per_hour")).alias("new_rate_limit"),
        F.when(ok, F.col("ts") + F.expr(f"INTERVAL {ROTATION_GRACE_HOURS} HOURS")).alias("grace_expires_at"),
    )


def apply_revocations(keys: DataFrame, events: DataFrame) -> DataFrame:
    """revocation inside the caller's org only: the events with ``status`` 204 or 404.
    ``apply_key_events`` gives the key table after them."""
    k = keys.select("key_id", F.col("org_id").alias("_k_org"), F.col("revoked_at").alias("_old"))
    j = events.join(k, "key_id", "left").withColumn(
        "status", F.when(F.col("_k_org").isNotNull() & (F.col("_k_org") == F.col("org_id")), 204).otherwise(404))
    return j


KEY_COLUMNS = ("key_id", "org_id", "name", "key_suffix", "key_hash", "created_at", "revoked_at", "grace_expires_at", "rotated_from_id", "rate_limit_per_hour")


def apply_key_events(keys: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F4 and F5 as a new version of the key table: (table, outcomes).

    ``events(event_id, kind, key_id, org_id, ts, new_key_id, new_hash, new_suffix)`` take effect in
    (ts, event_id) order; ``kind`` is ``rotate`` or ``revoke``, the ``new_`` columns describe the key that a
    rotation issues.  An event on a key that is unknown, not issued yet or in another org is 404;
    a rotation of a key that has a grace expiry is 409, else 201: the key gets a grace of 24 hours, and a
    successor with the same org and limit joins the table.  A revocation is 204 and
    sets ``revoked_at``; the last one counts.

    A key's fate depends on its own events only, found by a minimum and a maximum per key (partial
    aggregation, so a key with many events is no hot task).  Successors are the
    keys of the next round, which takes the events that name them: as many rounds as the longest
    chain of new keys, each written to the shared folder."""
    order = F.struct("ts", "event_id")
    cols = [c for c in KEY_COLUMNS if c in keys.columns]
    front = keys.select(*cols, F.lit(None).cast(events.select(order.alias("o")).schema["o"].dataType).alias("_born"))
    todo = written(events, "key-events")
    tables, outcomes = [], []
    while True:
        mine = todo.join(front.select("key_id", F.col("org_id").alias("_org"), F.col("grace_expires_at").alias("_grace"), "_born"), "key_id")
        known = (F.col("_org") == F.col("org_id")) & (F.col("_born").isNull() | (order > F.col("_born")))
        mine = mine.withColumn("_known", F.coalesce(known, F.lit(False)))
        rotates, revokes = F.col("_known") & (F.col("kind") == "rotate"), F.col("_known") & (F.col("kind") == "revoke")
        fate = written(mine.groupBy("key_id").agg(
            F.min(F.when(rotates & F.col("_grace").isNull(), F.struct("ts", "event_id", "new_key_id", "new_hash", "new_suffix"))).alias("_rotated"),
            F.max(F.when(revokes, order))["ts"].alias("_revoked")), "key-fates")
        won = mine.join(fate.select("key_id", F.col("_rotated.event_id").alias("_winner")), "key_id", "left")
        status = F.when(~F.col("_known"), 404).when(F.col("kind") == "revoke", 204).when(F.col("event_id").eqNullSafe(F.col("_winner")), 201).otherwise(409)
        outcomes.append(won.select("event_id", "key_id", "kind", status.alias("status")))
        after = front.join(fate, "key_id", "left")
        grace = F.col("_rotated.ts") + F.expr(f"INTERVAL {ROTATION_GRACE_HOURS} HOURS")
        tables.append(after.select(*[F.coalesce(F.col("_revoked"), "revoked_at").alias(c) if c == "revoked_at" else
                                     F.coalesce("grace_expires_at", grace).alias(c) if c == "grace_expires_at" else F.col(c) for c in cols]))
        new = {"key_id": F.col("_rotated.new_key_id"), "name": F.concat("name", F.lit(" (rotated)")), "key_suffix": F.col("_rotated.new_suffix"),
               "key_hash": F.col("_rotated.new_hash"), "created_at": F.col("_rotated.ts"), "rotated_from_id": F.col("key_id"),
               "revoked_at": F.lit(None), "grace_expires_at": F.lit(None)}
        born = after.where(F.col("_rotated").isNotNull())
        issued = written(born.select(*[(new[c].cast(keys.schema[c].dataType) if c in new else F.col(c)).alias(c) for c in cols],
                                     F.struct(F.col("_rotated.ts").alias("ts"), F.col("_rotated.event_id").alias("event_id")).alias("_born")), "key-successors")
        todo = todo.join(front.select("key_id"), "key_id", "left_anti")
        if issued.isEmpty():
            break
        front = issued
    outcomes.append(todo.select("event_id", "key_id", "kind", F.lit(404).alias("status")))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return union(tables), union(outcomes)


def key_lineage(spark, keys: DataFrame) -> DataFrame:
    """chain root and depth of every key through ``rotated_from_id``, by
    pointer doubling: each round joins every key to its ancestor's ancestor,
    so a chain of n links takes log2(n) joins. A missing predecessor ends the
    chain. Keys on a cycle, or behind one, have no root: null root and depth.

    Each round is written to the shared folder, which cuts lineage."""
    import math

    k = keys.select("key_id", F.col("rotated_from_id").alias("up"))
    known = k.select(F.col("key_id").alias("up")).distinct()
    parent = k.where("up IS NOT NULL").join(known, "up", "left_semi").select("key_id", F.col("up").alias("p"))
    state = written(k.join(parent, "key_id", "left").select(
        "key_id", F.coalesce("p", "key_id").alias("up"), F.col("p").isNotNull().cast("long").alias("depth"),
        F.col("p").isNull().alias("done")), "lineage")
    n, unfinished = state.agg(F.count(F.lit(1)), F.count_if(~F.col("done"))).first()
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        if not unfinished:
            break
        above = state.select(F.col("key_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("done").alias("done2"))
        todo = state.where(~F.col("done")).join(above, "up").select(
            "key_id", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("done2").alias("done"))
        state = written(state.where("done").unionByName(todo), "lineage")
        unfinished = state.where(~F.col("done")).count()
    return state.select("key_id", F.when(F.col("done"), F.col("up")).alias("root_id"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def with_limit(keys: DataFrame, requested: Column | None = None) -> DataFrame:
    """E5: effective per-hour limit; a falsy request value (NULL or 0) falls
    back to the default."""
    v = F.col("rate_limit_per_hour") if requested is None else requested
    return keys.withColumn("effective_limit", F.when(v.isNull() | (v == 0), F.lit(DEFAULT_RATE_LIMIT)).otherwise(v))


def list_keys(keys: DataFrame, org_id: int) -> DataFrame:
    """An org's keys without secrets."""
    return keys.where(F.col("org_id") == org_id).select(
        "key_id", "org_id", "name", "key_suffix", "rate_limit_per_hour", "rotated_from_id",
        "created_at", "revoked_at", "grace_expires_at")


def integrity_violations(keys: DataFrame, orgs: DataFrame) -> DataFrame:
    """F8: duplicate key hashes and keys whose org does not exist."""
    dup = (keys.groupBy("key_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
               .select(F.lit("duplicate_key_hash").alias("violation"), F.col("key_hash").alias("detail")))
    orphan = (keys.join(orgs.select("org_id"), "org_id", "left_anti")
                  .select(F.lit("orphan_key").alias("violation"), F.col("key_id").cast("string").alias("detail")))
    return dup.unionByName(orphan)


def cascade_delete(org_ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """drop every row of an org being deleted, down the FK chain.

    ``tables`` maps table name -> DataFrame with an ``org_id`` column (keys,
    requests, payloads via their request's org, cache entries)."""
    doomed = org_ids.select("org_id").distinct()
    return {name: df.join(doomed, "org_id", "left_anti") for name, df in tables.items()}
