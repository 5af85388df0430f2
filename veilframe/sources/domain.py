"""Domain tables derived from the fixture tables (FIXTURES.md part 3).

Each derivation exists twice: as a DataFrame (used by the queries) and as a
DuckDB CTE body (used by the oracles).  Integer arithmetic and hashes only,
no randomness, so both sides produce the same rows.

Scale notes: ``orgs`` comes from ``nation`` and has a fixed 25 rows at every
scale factor, so it is the only table we broadcast explicitly.  ``api_keys``
and ``requests`` grow with the data; joins against them are left to the
optimizer's size-checked strategy choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.tables import load

# Provider names and the pre-warmed (provider, model) cache
# partitions of the reference's configuration, in their natural order.
PROVIDERS = ("openai", "anthropic", "gemini")
PREWARMED = (
    ("openai", "gpt-4o"), ("openai", "gpt-4o-mini"), ("openai", "gpt-4-turbo"),
    ("anthropic", "claude-3-5-sonnet-20241022"), ("anthropic", "claude-3-5-haiku-20241022"),
    ("anthropic", "claude-3-opus-20240229"),
    ("gemini", "gemini-1.5-pro"), ("gemini", "gemini-1.5-flash"),
)
# Credential prefix and suffix length used for key matching.
KEY_PREFIX = "key-"
SUFFIX_LEN = 4


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


def _pick(values, idx: Column) -> Column:
    """element of a literal list by 0-based integer index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


# ---------------------------------------------------------------------------
# orgs <- nation
# ---------------------------------------------------------------------------
def orgs(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("long").alias("org_id"),
        F.col("n_name").alias("name"),
        (k % 2 == 0).alias("raw_logging_opt_in"),
        F.when(k % 5 == 0, F.lit(0)).when(k % 5 == 1, F.lit(None)).otherwise(F.lit(86400)).cast("int")
        .alias("cache_ttl_seconds"),
        F.when(k % 4 == 0, F.lit(0.0)).when(k % 4 == 1, F.lit(None)).otherwise(F.lit(0.40)).cast("double")
        .alias("cache_similarity_threshold"),
        (k % 3 != 0).alias("has_wrapped_key"),
    )


ORGS_SQL = """SELECT n_nationkey::BIGINT AS org_id, n_name AS name, (n_nationkey % 2 = 0) AS raw_logging_opt_in,
  (CASE WHEN n_nationkey % 5 = 0 THEN 0 WHEN n_nationkey % 5 = 1 THEN NULL ELSE 86400 END)::INTEGER AS cache_ttl_seconds,
  (CASE WHEN n_nationkey % 4 = 0 THEN 0.0 WHEN n_nationkey % 4 = 1 THEN NULL ELSE 0.40 END)::DOUBLE AS cache_similarity_threshold,
  (n_nationkey % 3 <> 0) AS has_wrapped_key
FROM nation"""


# ---------------------------------------------------------------------------
# api_keys <- customer
# ---------------------------------------------------------------------------
def token_of(custkey: Column) -> Column:
    return F.concat(F.lit(KEY_PREFIX), F.substring(F.sha2(F.concat(F.lit("k"), custkey.cast("string")), 256), 1, 32))


def key_hash_of(token: Column) -> Column:
    """Salted SHA-256 stands in for the per-key KDF (not built, see README)."""
    return F.sha2(F.concat(F.lit("salt"), token), 256)


def api_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    tok = token_of(k)
    return c.select(
        k.alias("key_id"),
        F.col("c_nationkey").cast("long").alias("org_id"),
        F.col("c_name").alias("name"),
        tok.alias("token"),
        F.substring(tok, -SUFFIX_LEN, SUFFIX_LEN).alias("key_suffix"),
        key_hash_of(tok).alias("key_hash"),
        F.lit("1994-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.when(k % 17 == 0, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).alias("revoked_at"),
        F.when(k % 13 == 0, F.lit("1999-06-01 00:00:00").cast("timestamp_ntz")).alias("grace_expires_at"),
        F.when((k % 10).isin(3, 4, 5), k - 1).alias("rotated_from_id"),
        F.when(k % 7 == 0, F.lit(0)).otherwise(F.lit(2) + k % 5).cast("int").alias("rate_limit_per_hour"),
    )


API_KEYS_SQL = f"""SELECT c_custkey AS key_id, c_nationkey::BIGINT AS org_id, c_name AS name, tok AS token,
  right(tok, {SUFFIX_LEN}) AS key_suffix, sha256('salt' || tok) AS key_hash,
  TIMESTAMP '1994-01-01 00:00:00' AS created_at,
  CASE WHEN c_custkey % 17 = 0 THEN TIMESTAMP '1998-01-01 00:00:00' END AS revoked_at,
  CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP '1999-06-01 00:00:00' END AS grace_expires_at,
  CASE WHEN c_custkey % 10 IN (3, 4, 5) THEN c_custkey - 1 END AS rotated_from_id,
  (CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 2 + c_custkey % 5 END)::INTEGER AS rate_limit_per_hour
FROM (SELECT *, '{KEY_PREFIX}' || substr(sha256('k' || CAST(c_custkey AS VARCHAR)), 1, 32) AS tok FROM customer)"""


# ---------------------------------------------------------------------------
# requests <- orders joined with customer
# ---------------------------------------------------------------------------
def requests(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    """Request rows; ``orders`` may be a stream of order rows (a stream-static
    join with customer then yields a request stream)."""
    o = orders if orders is not None else load(spark, sf, "orders")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    model_idx = k % len(PREWARMED)
    other = k % 11 == 0
    is_stream = k % 9 == 0
    status = (F.when(F.col("o_orderpriority") == "1-URGENT", 500)
               .when(F.col("o_orderpriority") == "2-HIGH", 429).otherwise(200))
    cats = F.element_at(F.array(
        F.array().cast("array<string>"), F.array(F.lit("EMAIL_ADDRESS")),
        F.array(F.lit("EMAIL_ADDRESS"), F.lit("PHONE_NUMBER")), F.array(F.lit("CREDIT_CARD"))),
        (k % 4 + 1).cast("int"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    return j.select(
        k.alias("request_id"),
        F.col("o_custkey").alias("api_key_id"),
        F.col("c_nationkey").cast("long").alias("org_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(other, _pick(PROVIDERS, k % 3)).otherwise(_pick([p for p, _ in PREWARMED], model_idx)).alias("provider"),
        F.when(other, F.lit("other")).otherwise(_pick([m for _, m in PREWARMED], model_idx)).alias("model"),
        status.alias("status"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("latency_ms"),
        (k % 2048).cast("int").alias("prompt_tokens"),
        F.when(is_stream, 0).otherwise(k % 512).cast("int").alias("completion_tokens"),
        is_stream.alias("is_stream"),
        ((k % 4 == 0) & ~is_stream).alias("cache_hit"),
        F.substring(F.sha2(k.cast("string"), 256), 1, 32).alias("trace_id"),
        F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("o_orderpriority")), 256).alias("request_hash"),
        cats.alias("pii_categories"),
        (k % 5).cast("int").alias("pii_entity_count"),
        F.col("o_totalprice").alias("o_totalprice"),
    )


REQUESTS_SQL = f"""SELECT o_orderkey AS request_id, o_custkey AS api_key_id, c_nationkey::BIGINT AS org_id,
  o_orderdate AS created_at,
  CASE WHEN o_orderkey % 11 = 0 THEN {_sql_list(PROVIDERS)}[o_orderkey % 3 + 1]
       ELSE {_sql_list([p for p, _ in PREWARMED])}[o_orderkey % {len(PREWARMED)} + 1] END AS provider,
  CASE WHEN o_orderkey % 11 = 0 THEN 'other'
       ELSE {_sql_list([m for _, m in PREWARMED])}[o_orderkey % {len(PREWARMED)} + 1] END AS model,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 500 WHEN o_orderpriority = '2-HIGH' THEN 429 ELSE 200 END AS status,
  floor(o_totalprice / 100)::BIGINT AS latency_ms,
  (o_orderkey % 2048)::INTEGER AS prompt_tokens,
  (CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_orderkey % 512 END)::INTEGER AS completion_tokens,
  (o_orderkey % 9 = 0) AS is_stream,
  (o_orderkey % 4 = 0 AND NOT (o_orderkey % 9 = 0)) AS cache_hit,
  substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 32) AS trace_id,
  sha256(CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority) AS request_hash,
  [[]::VARCHAR[], ['EMAIL_ADDRESS'], ['EMAIL_ADDRESS', 'PHONE_NUMBER'], ['CREDIT_CARD']][o_orderkey % 4 + 1] AS pii_categories,
  (o_orderkey % 5)::INTEGER AS pii_entity_count,
  o_totalprice
FROM orders JOIN customer ON c_custkey = o_custkey"""


# ---------------------------------------------------------------------------
# auth_attempts <- orders
# ---------------------------------------------------------------------------
def auth_attempts(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    tok = token_of(F.col("o_custkey"))
    presented = (F.when(k % 19 == 0, F.lit(None).cast("string"))
                  .when(k % 23 == 0, F.lit("bad"))
                  .when(k % 29 == 0, F.concat(F.lit(KEY_PREFIX + "x" * 32), F.substring(tok, -SUFFIX_LEN, SUFFIX_LEN)))
                  .otherwise(tok))
    return o.select(k.alias("attempt_id"), F.col("o_orderdate").alias("ts"), presented.alias("presented"))


AUTH_ATTEMPTS_SQL = f"""SELECT o_orderkey AS attempt_id, o_orderdate AS ts,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'bad'
       WHEN o_orderkey % 29 = 0 THEN '{KEY_PREFIX}{"x" * 32}' || right(tok, {SUFFIX_LEN})
       ELSE tok END AS presented
FROM (SELECT *, '{KEY_PREFIX}' || substr(sha256('k' || CAST(o_custkey AS VARCHAR)), 1, 32) AS tok FROM orders)"""


def with_views(body: str, *names: str) -> str:
    """Prefix a SELECT with the CTEs of the named domain tables."""
    defs = {"orgs": ORGS_SQL, "api_keys": API_KEYS_SQL, "requests": REQUESTS_SQL,
            "auth_attempts": AUTH_ATTEMPTS_SQL}
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in names)
    return f"WITH {ctes}\n{body}"
