"""Structured Streaming queries (E7, M6, A6/A7 streaming) with batch twins
as oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions.timeutil import utc_instant
from veilframe.operators.ratelimit import WINDOW_MS, epoch_ms
from veilframe.plans.rate_queries import LIMIT, _replay_sql
from veilframe.plans.history_queries import AUDIT_ROUNDTRIP_SQL
from veilframe.plans.registry import register
from veilframe.streaming import admission as SA
from veilframe.streaming.runner import read_table_stream, run_available_now

TTL_S = 300
TURN_GAP_S = 70
BASE = "2024-01-01 00:00:00"


@register("admission_stream", operators=("E7",), oracle=_replay_sql() +
          "SELECT event_id, admitted, cur::INTEGER AS current FROM run")
def q_admission_stream(spark, sf):
    ev = read_table_stream(spark, sf, "events").select(
        F.col("event_type").alias("rl_key"), epoch_ms(F.col("ts")).alias("t"), "event_id",
        utc_instant(F.col("ts")).alias("event_time"))
    out = run_available_now(SA.admit_stream(ev, LIMIT, WINDOW_MS), "admission_stream")
    return out.select("event_id", "admitted", "current")


WINDOW = "1 hour"
WATERMARK = "10 minutes"


@register("request_counts_stream", operators=("M6",), oracle="""
SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start_s, event_type, count(*) AS n
FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type
HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def q_request_counts_stream(spark, sf):
    """Hourly event counters on event time with a 10-minute watermark; the
    batch twin is compared on the windows the watermark has closed."""
    ev = read_table_stream(spark, sf, "events").select(utc_instant(F.col("ts")).alias("ts"), "event_type")
    out = run_available_now(SA.request_counts_stream(ev, "ts", WINDOW, WATERMARK, ["event_type"]), "counts_stream")
    return out.select(F.unix_seconds("window.start").alias("window_start_s"), "event_type", "n")


@register("mapping_ttl_join", operators=("A6", "A7"), oracle=f"""
SELECT conv_id AS request_id, turn FROM conversations WHERE turn * {TURN_GAP_S} <= {TTL_S}""")
def q_mapping_ttl_join(spark, sf):
    """Mappings are staged when a conversation starts (turn 0); each turn's
    response is sent 70 s after the previous one; a response may use the
    mapping only within its 300 s life."""
    conv = read_table_stream(spark, sf, "conversations")
    base = F.lit(BASE).cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, conv_id * 60)")
    mappings = conv.where(F.col("turn") == 0).select(F.col("conv_id").alias("request_id"), base.alias("staged_at"))
    conv2 = read_table_stream(spark, sf, "conversations")
    base2 = F.lit(BASE).cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, conv_id * 60)")
    responses = conv2.select(F.col("conv_id").alias("request_id"), "turn",
                             (base2 + F.expr(f"make_interval(0, 0, 0, 0, 0, 0, turn * {TURN_GAP_S})")).alias("sent_at"))
    j = SA.mapping_ttl_join(mappings, responses, TTL_S, "10 minutes")
    out = run_available_now(j.select(F.col("m.request_id").alias("request_id"), F.col("r.turn").alias("turn")),
                            "mapping_ttl_join")
    return out


@register("audit_stream_roundtrip", operators=("A3", "G6"), oracle=AUDIT_ROUNDTRIP_SQL)
def q_audit_stream_roundtrip(spark, sf):
    """Orders arrive as a stream; a stream-static join with customer turns
    them into requests, audit rows are built per micro-batch and appended
    idempotently (one directory per batch id, partitioned by month); the
    table read back answers the same monthly question as the batch append."""
    import uuid

    from veilframe.operators import audit as A
    from veilframe.plans.audit_queries import _prices
    from veilframe.session import scratch_path
    from veilframe.sources import domain as D
    from veilframe.streaming.runner import append_idempotent

    orders = read_table_stream(spark, sf, "orders", max_files=1)
    audit = A.build_audit(D.requests(spark, sf, orders), _prices(spark)).withColumn(
        "created_month", F.date_format("created_at", "yyyy-MM"))
    path = scratch_path(spark, f"audit-stream-{uuid.uuid4().hex}/table")
    append_idempotent(audit, path, ("created_month",))
    return spark.read.parquet(path).groupBy(F.col("created_month").alias("month")).agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.sum("estimated_cost_usd"), 4).alias("cost_usd"))
