"""Envelope encryption as column jobs.

Payloads are sealed with AES-256-GCM through Spark's built-in
``aes_encrypt``; the output is ``iv || ciphertext || tag``.  Every row gets
an explicit 12-byte IV drawn from the operating system's CSPRNG by a
non-deterministic pandas UDF: letting Spark pick the IV is not safe, because
a call whose arguments are all literals is constant-folded and then shares
one nonce across rows.  Because the IV is random, sealed output must be
written once (a table in the shared checkpoint folder), not recomputed.

Per-org data keys (DEKs) are wrapped under a master key with their own AAD.
Joins against the org table are left to the optimizer's size-checked choice.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Associated data labels, and envelope geometry.
AAD_PROMPT = "payload/prompt/1"
AAD_RESPONSE = "payload/response/1"
AAD_DEK_WRAP = "org/data-key/1"
NONCE_BYTES = 12
TAG_BYTES = 16
DEK_BYTES = 32
MIN_WRAPPED_BYTES = NONCE_BYTES + 1


@F.pandas_udf(T.BinaryType())
def _random_iv(seed: pd.Series) -> pd.Series:
    return pd.Series([os.urandom(NONCE_BYTES) for _ in range(len(seed))])


random_iv_udf = _random_iv.asNondeterministic()


def random_iv(anchor: Column) -> Column:
    """A fresh 12-byte IV per row (``anchor`` only sizes the batch)."""
    return random_iv_udf(anchor)


def seal(plaintext: Column, key: Column, aad: str, iv: Column) -> Column:
    """H1: AES-256-GCM, output ``iv || ct || tag``."""
    return F.aes_encrypt(plaintext.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), iv, F.lit(aad))


def unseal(sealed: Column, key: Column, aad: str) -> Column:
    """H2: NULL when the key or the AAD does not match (never raises)."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))


def derive_dek(org_id: Column, salt: str = "dek") -> Column:
    """A deterministic 32-byte data key per org for fixtures (a real
    deployment supplies generated keys)."""
    return F.unhex(F.sha2(F.concat(F.lit(salt), org_id.cast("string")), 256))


def wrap_keys(orgs: DataFrame, master: Column, dek_col: str = "dek") -> DataFrame:
    """H3: wrap each org's DEK under the master key."""
    return orgs.withColumn("iv", random_iv(F.col("org_id"))).withColumn(
        "encryption_key_wrapped", seal(F.col(dek_col), master, AAD_DEK_WRAP, F.col("iv"))).drop("iv")


def unwrap_keys(orgs: DataFrame, master: Column) -> DataFrame:
    """H3: unwrap; a wrapped value shorter than 13 bytes or a DEK that is not
    32 bytes is malformed (NULL key plus an error label)."""
    w = F.col("encryption_key_wrapped")
    dek = F.when(F.length(w) >= MIN_WRAPPED_BYTES, F.try_aes_decrypt(w, master, F.lit("GCM"), F.lit("DEFAULT"),
                                                                  F.lit(AAD_DEK_WRAP)))
    ok = dek.isNotNull() & (F.length(dek) == DEK_BYTES)
    return orgs.withColumn("dek", F.when(ok, dek)).withColumn(
        "key_error", F.when(w.isNull(), F.lit(None)).when(~ok, F.lit("MALFORMED_WRAPPED_KEY")))


def sealed_payloads(payloads: DataFrame, orgs: DataFrame, master: Column,
                    text_cols: dict[str, str]) -> DataFrame:
    """Keep rows of orgs that opted in and hold a wrapped key
    (semi-join on the bounded org table), unwrap the org key and seal each
    text column with its AAD.  A row whose key cannot be opened keeps its
    audit row elsewhere and simply gets no payload here."""
    keys = unwrap_keys(orgs.where(F.col("raw_logging_opt_in") & F.col("encryption_key_wrapped").isNotNull()), master)
    keys = keys.where(F.col("dek").isNotNull()).select("org_id", "dek")
    j = payloads.join(keys, "org_id", "inner")
    for out, (src, aad) in text_cols.items():
        j = j.withColumn(out, seal(F.col(src), F.col("dek"), aad, random_iv(F.col(src))))
    return j


def reseal(sealed: DataFrame, col: str, old_key: Column, new_key: Column, aad: str) -> DataFrame:
    """H4: open under the old key and seal again under the new one."""
    plain = unseal(F.col(col), old_key, aad)
    return sealed.withColumn(col, seal(plain, new_key, aad, random_iv(F.col(col))))


def nonce_collisions(sealed: DataFrame, key_cols: list[str], col: str) -> DataFrame:
    """H5: a nonce used twice under one key; must be empty."""
    return (sealed.groupBy(*key_cols, F.substring(F.col(col), 1, NONCE_BYTES).alias("nonce"))
                  .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def evolve_payloads(df: DataFrame, to_version: int, nonce_col: str = "nonce") -> DataFrame:
    """Version 2 drops the shared ``nonce`` column and nothing else (each
    ciphertext carries its own nonce as prefix); going back to version 1 adds a
    12-byte zero nonce column. So 2 -> 1 -> 2 keeps every ciphertext."""
    if to_version >= 2:
        return df.drop(nonce_col)
    return df.withColumn(nonce_col, F.unhex(F.lit("00" * NONCE_BYTES)))
