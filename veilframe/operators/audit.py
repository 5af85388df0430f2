"""Audit rows, usage rollups and response summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The audit columns of one request row, in table order.
AUDIT_COLUMNS = (
    "request_id", "org_id", "api_key_id", "request_hash", "provider", "model",
    "prompt_tokens", "completion_tokens", "estimated_cost_usd", "latency_ms", "cache_hit",
    "pii_categories", "pii_entity_count", "error_code", "trace_id", "created_at",
)


def approx_tokens(text: Column) -> Column:
    """G1: empty -> 0, else max(1, ceil(chars / 4)) in code points."""
    return (F.when(text.isNull() | (text == ""), F.lit(0))
             .otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 4))).cast("int"))


def with_error_code(df: DataFrame, status_col: str = "status") -> DataFrame:
    """``upstream_<status>`` iff status >= 400."""
    s = F.col(status_col)
    return df.withColumn("error_code", F.when(s >= 400, F.concat(F.lit("upstream_"), s.cast("string"))))


def with_cost(df: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Cost from a (provider, model) price table per 1k tokens; 0.0 when
    no price is known."""
    if prices is None:
        return df.withColumn("estimated_cost_usd", F.lit(0.0))
    p = prices.select("provider", "model", "prompt_per_1k", "completion_per_1k")
    cost = (F.col("prompt_tokens") * F.col("prompt_per_1k") + F.col("completion_tokens") * F.col("completion_per_1k")) / 1000
    return (df.join(p, ["provider", "model"], "left")
              .withColumn("estimated_cost_usd", F.coalesce(cost, F.lit(0.0)))
              .drop("prompt_per_1k", "completion_per_1k"))


def build_audit(requests: DataFrame, prices: DataFrame | None = None, keep=()) -> DataFrame:
    """One metadata row per request, defaults filled: tokens 0, cost 0,
    cache_hit false, categories empty.  No prompt or response text.  ``keep``
    carries extra request columns through (no join back)."""
    df = with_cost(with_error_code(requests), prices)
    return df.select(*keep,
        "request_id", "org_id", "api_key_id", "request_hash", "provider", "model",
        F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"),
        "estimated_cost_usd", "latency_ms",
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"),
        F.coalesce("pii_categories", F.array().cast("array<string>")).alias("pii_categories"),
        F.coalesce("pii_entity_count", F.lit(0)).alias("pii_entity_count"),
        "error_code", "trace_id", "created_at")


def append_audit(audit: DataFrame, path: str, granularity: str = "day") -> str:
    """A3: append, partitioned by time so range reads prune files.

    Rows are clustered by the partition value before the write (``rebalance``:
    adaptive execution splits a large day over several tasks and joins small
    ones), so a partition directory gets few files.  ``granularity`` is "day" (``created_date``) or "month"
    (``created_month``); returns the partition column name."""
    if granularity == "day":
        col, value = "created_date", F.to_date("created_at")
    else:
        col, value = "created_month", F.date_format("created_at", "yyyy-MM")
    out = audit.withColumn(col, value)
    out.hint("rebalance", F.col(col)).write.mode("append").partitionBy(col).parquet(path)
    return col


def usage_rollup(audit: DataFrame, dims=("org_id", "provider", "model", "day")) -> DataFrame:
    """Requests, tokens, cost, hits, errors, PII entities per group
    (partial aggregation before the shuffle)."""
    a = audit.withColumn("day", F.to_date("created_at"))
    return a.groupBy(*dims).agg(*usage_measures())


def usage_measures():
    return [
        F.count(F.lit(1)).alias("requests"),
        F.sum("prompt_tokens").cast("long").alias("prompt_tokens"),
        F.sum("completion_tokens").cast("long").alias("completion_tokens"),
        F.round(F.sum("estimated_cost_usd"), 2).alias("cost_usd"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(F.col("error_code").isNotNull()).alias("errors"),
        F.sum("pii_entity_count").cast("long").alias("pii_entities"),
    ]


def org_timeline(audit: DataFrame, org_id: int, start: str, end: str, limit: int | None = None) -> DataFrame:
    """An org's requests in [start, end) ordered by time, all of them
    unless a ``limit`` is given.  Filters reach the parquet scan (and partition filters on
    the day layout)."""
    found = (audit.where((F.col("org_id") == org_id) & (F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
                        & (F.col("created_at") < F.lit(end).cast("timestamp_ntz")))
                  .orderBy("created_at", "request_id"))
    return found if limit is None else found.limit(limit)


def repeat_requests(audit: DataFrame) -> DataFrame:
    """Request hashes seen more than once."""
    return audit.groupBy("request_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def category_prevalence(audit: DataFrame) -> DataFrame:
    """Requests carrying each PII category."""
    return (audit.select(F.explode_outer(F.array_distinct("pii_categories")).alias("category"))
                 .where(F.col("category").isNotNull())
                 .groupBy("category").agg(F.count(F.lit(1)).alias("requests")))


def response_summary(df: DataFrame) -> DataFrame:
    """Header-style fields of a served response."""
    return df.select(
        "request_id",
        F.array_join(F.array_sort("pii_categories"), ",").alias("pii_categories"),
        F.when(F.col("cache_hit"), "true").otherwise("false").alias("cache_hit_header"),
        F.floor(F.col("latency_ms")).cast("long").alias("latency_ms_header"))


def hex_id(x: Column, width: int) -> Column:
    """Fixed-width lower-case hex of a non-negative id; 0 -> NULL."""
    return F.when(x == 0, F.lit(None).cast("string")).otherwise(F.lpad(F.lower(F.hex(x)), width, "0"))


def retention_violations(audit: DataFrame, payloads: DataFrame, orgs: DataFrame) -> DataFrame:
    """Text columns in the audit schema, and payload rows whose org did
    not opt in.  Must be empty."""
    text_cols = [f.name for f in audit.schema.fields if f.name in ("prompt", "response", "text", "body")]
    opted = orgs.where(F.col("raw_logging_opt_in")).select("org_id")
    bad = payloads.join(opted, "org_id", "left_anti").select(
        F.lit("payload_without_opt_in").alias("violation"), F.col("request_id").cast("string").alias("detail"))
    if text_cols:
        schema_bad = audit.sparkSession.createDataFrame(
            [("text_column", c) for c in text_cols], "violation string, detail string")
        bad = bad.unionByName(schema_bad)
    return bad
