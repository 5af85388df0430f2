"""Sealing queries: opt-in payloads from ``conversations`` per org (A8, A11,
G7, H1-H5).  Ciphertext is random, so sealed tables are written once to the
shared checkpoint folder and every check reads that table back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilframe.operators import sealing as S
from veilframe.plans.registry import register
from veilframe.session import scratch_path
from veilframe.sources import domain as D
from veilframe.sources.tables import load

MASTER = "veilframe-fixture-master-key"
ORG_SQL = "conv_id % 25"
ELIGIBLE_SQL = f"({ORG_SQL}) % 2 = 0 AND ({ORG_SQL}) % 3 <> 0"


def master_key():
    return F.unhex(F.sha2(F.lit(MASTER), 256))


def wrapped_orgs(spark, sf):
    o = D.orgs(spark, sf).withColumn("dek", S.derive_dek(F.col("org_id")))
    w = S.wrap_keys(o.where(F.col("has_wrapped_key")), master_key()).drop("dek")
    rest = o.where(~F.col("has_wrapped_key")).drop("dek").withColumn("encryption_key_wrapped", F.lit(None).cast("binary"))
    return w.unionByName(rest)


def _sealed_table(spark, sf):
    """Seal every turn of conversations whose org opted in; write once."""
    c = load(spark, sf, "conversations").select(
        "conv_id", "turn", "text", (F.col("conv_id") % 25).cast("long").alias("org_id"))
    sealed = S.sealed_payloads(c, wrapped_orgs(spark, sf), master_key(),
                               {"prompt_ciphertext": ("text", S.AAD_PROMPT)})
    path = scratch_path(spark, f"sealed-{uuid.uuid4().hex}")
    sealed.select("conv_id", "turn", "org_id", "prompt_ciphertext").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _with_text(spark, sf, sealed):
    """The plaintext beside its ciphertext, for comparison only: it is joined back and never written."""
    return sealed.join(load(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])


def _with_dek(df, salt="dek"):
    return df.withColumn("dek", S.derive_dek(F.col("org_id"), salt))


@register("sealed_roundtrip", operators=("H1", "H2", "A8"), oracle=f"""
SELECT conv_id, turn, TRUE AS ok, octet_length(encode(text)) + 28 AS ct_len FROM conversations WHERE {ELIGIBLE_SQL}""")
def q_sealed_roundtrip(spark, sf):
    t = _with_dek(_with_text(spark, sf, _sealed_table(spark, sf)))
    opened = S.unseal(F.col("prompt_ciphertext"), F.col("dek"), S.AAD_PROMPT)
    return t.select("conv_id", "turn", F.coalesce(opened == F.col("text").cast("binary"), F.lit(False)).alias("ok"),
                    F.length("prompt_ciphertext").cast("long").alias("ct_len"))


@register("aad_mismatch", operators=("H2",), oracle=f"""
SELECT count(*) AS n_rows, 0::BIGINT AS n_opened_with_wrong_aad FROM conversations WHERE {ELIGIBLE_SQL}""")
def q_aad_mismatch(spark, sf):
    t = _with_dek(_sealed_table(spark, sf))
    wrong = S.unseal(F.col("prompt_ciphertext"), F.col("dek"), S.AAD_RESPONSE)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.count(wrong).alias("n_opened_with_wrong_aad"))


@register("nonce_collisions", operators=("H5",), oracle="SELECT 1::BIGINT AS org_id, ''::BLOB AS nonce, 1::BIGINT AS n WHERE FALSE")
def q_nonce_collisions(spark, sf):
    return S.nonce_collisions(_sealed_table(spark, sf), ["org_id"], "prompt_ciphertext")


@register("wrapped_keys", operators=("H3",), oracle=D.with_views("""
SELECT org_id, CASE WHEN has_wrapped_key THEN (CASE WHEN org_id % 7 = 3 THEN 10 ELSE 60 END) END AS wrapped_len,
       CASE WHEN NOT has_wrapped_key THEN NULL WHEN org_id % 7 = 3 THEN 'MALFORMED_WRAPPED_KEY' END AS key_error,
       has_wrapped_key AND org_id % 7 <> 3 AS dek_ok
FROM orgs""", "orgs"))
def q_wrapped_keys(spark, sf):
    """Wrap every org key, truncate the wrapped value of orgs with id % 7 = 3
    to 10 bytes (a corrupted row), then unwrap."""
    w = wrapped_orgs(spark, sf)
    path = scratch_path(spark, f"wrapped-{uuid.uuid4().hex}")
    w.write.mode("overwrite").parquet(path)
    w = spark.read.parquet(path)
    w = w.withColumn("encryption_key_wrapped", F.when(F.col("org_id") % 7 == 3, F.substring("encryption_key_wrapped", 1, 10))
                     .otherwise(F.col("encryption_key_wrapped")))
    u = S.unwrap_keys(w, master_key())
    ok = F.coalesce(F.col("dek") == S.derive_dek(F.col("org_id")), F.lit(False))
    return u.select("org_id", F.length("encryption_key_wrapped").alias("wrapped_len"), "key_error", ok.alias("dek_ok"))


@register("reseal_roundtrip", operators=("H4",), oracle=f"""
SELECT conv_id, turn, TRUE AS ok_new, TRUE AS fails_old FROM conversations WHERE {ELIGIBLE_SQL}""")
def q_reseal_roundtrip(spark, sf):
    t = _with_dek(_sealed_table(spark, sf)).withColumn("dek_new", S.derive_dek(F.col("org_id"), "dek2"))
    r = S.reseal(t, "prompt_ciphertext", F.col("dek"), F.col("dek_new"), S.AAD_PROMPT)
    path = scratch_path(spark, f"resealed-{uuid.uuid4().hex}")
    r.drop("dek", "dek_new").write.mode("overwrite").parquet(path)
    r = _with_text(spark, sf, _with_dek(spark.read.parquet(path))).withColumn("dek_new", S.derive_dek(F.col("org_id"), "dek2"))
    new_open = S.unseal(F.col("prompt_ciphertext"), F.col("dek_new"), S.AAD_PROMPT)
    old_open = S.unseal(F.col("prompt_ciphertext"), F.col("dek"), S.AAD_PROMPT)
    return r.select("conv_id", "turn", F.coalesce(new_open == F.col("text").cast("binary"), F.lit(False)).alias("ok_new"),
                    old_open.isNull().alias("fails_old"))


@register("evolved_payloads", operators=("A11",), oracle=f"""
SELECT conv_id, turn, octet_length(encode(text)) + 28 AS v2_len, TRUE AS ok, 12 AS v1_nonce_len
FROM conversations WHERE {ELIGIBLE_SQL}""")
def q_evolved_payloads(spark, sf):
    """Down to version 1 (a zero nonce column), up again and down: every
    ciphertext still opens."""
    t = _with_dek(_with_text(spark, sf, _sealed_table(spark, sf)))
    back = S.evolve_payloads(S.evolve_payloads(S.evolve_payloads(t, 1), 2), 1)
    opened = S.unseal(F.col("prompt_ciphertext"), F.col("dek"), S.AAD_PROMPT)
    return back.select("conv_id", "turn", F.length("prompt_ciphertext").cast("long").alias("v2_len"),
                       F.coalesce(opened == F.col("text").cast("binary"), F.lit(False)).alias("ok"),
                       F.length("nonce").alias("v1_nonce_len"))
