"""Rate-limit queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import ratelimit as R
from veilframe.plans.registry import register
from veilframe.sources.tables import load

LIMIT = 2  # per hour, so that the limit binds on the fixtures
W = R.WINDOW_MS


def rate_events(spark, sf, key="event_type"):
    e = load(spark, sf, "events")
    return e.select(F.col(key).cast("string").alias("rl_key"), R.epoch_ms(F.col("ts")).alias("t"),
                    F.col("event_id"))


def _replay_sql(key: str = "event_type", limit: int = LIMIT) -> str:
    """Sequential replay as a recursive CTE: one step per request of a key,
    the state a list of admitted timestamps still inside the window."""
    live = f"list_filter(r.adm, lambda a: a > e.t - {W})"
    return f"""WITH RECURSIVE ev AS (
  SELECT CAST({key} AS VARCHAR) AS rl_key, (epoch_us(ts) // 1000) AS t, event_id,
         row_number() OVER (PARTITION BY {key} ORDER BY (epoch_us(ts) // 1000), event_id) AS rn
  FROM events),
run(rl_key, rn, t, event_id, adm, admitted, cur, retry) AS (
  SELECT rl_key, rn, t, event_id, [t], TRUE, 1, 0::BIGINT FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.rl_key, e.rn, e.t, e.event_id,
         CASE WHEN len({live}) < {limit} THEN list_append({live}, e.t) ELSE {live} END,
         len({live}) < {limit},
         CASE WHEN len({live}) < {limit} THEN len({live}) + 1 ELSE len({live}) END,
         CASE WHEN len({live}) < {limit} THEN 0 ELSE {W} - (e.t - list_min({live})) END
  FROM run r JOIN ev e ON e.rl_key = r.rl_key AND e.rn = r.rn + 1)
"""


def _admitted(spark, sf, key="event_type"):
    return R.admit(rate_events(spark, sf, key), "rl_key", "t", "event_id", LIMIT)


@register("offered_rate", operators=("E1",), oracle=f"""
SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000)
                                RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS offered
FROM events""")
def q_offered_rate(spark, sf):
    return R.offered_rate(rate_events(spark, sf), "rl_key", "t").select("event_id", "offered")


@register("admission", operators=("E2", "E3"), oracle=_replay_sql() +
          "SELECT event_id, admitted, cur::INTEGER AS current FROM run")
def q_admission(spark, sf):
    return _admitted(spark, sf).select("event_id", "admitted", "current")


@register("admission_by_user", operators=("E2", "E3"), oracle=_replay_sql("user_id") +
          "SELECT event_id, admitted, cur::INTEGER AS current FROM run")
def q_admission_by_user(spark, sf):
    return _admitted(spark, sf, "user_id").select("event_id", "admitted", "current")


@register("retry_after", operators=("E4",), oracle=_replay_sql() + """
SELECT event_id, retry::BIGINT AS retry_after_ms, greatest(1, floor(retry / 1000))::BIGINT AS retry_after_s
FROM run WHERE NOT admitted""")
def q_retry_after(spark, sf):
    a = _admitted(spark, sf).where(~F.col("admitted"))
    return a.select("event_id", "retry_after_ms", R.retry_after_seconds(F.col("retry_after_ms")).alias("retry_after_s"))


@register("rejections", operators=("E6",), oracle=_replay_sql() + f"""
SELECT rl_key, count(*) AS rejected, max(cur)::INTEGER AS max_current, {LIMIT} AS "limit", 'RATE_LIMITED' AS error
FROM run WHERE NOT admitted GROUP BY rl_key""")
def q_rejections(spark, sf):
    r = R.rejections(_admitted(spark, sf), LIMIT)
    return r.groupBy("rl_key").agg(F.count(F.lit(1)).alias("rejected"), F.max("current").alias("max_current"),
                                   F.first("limit").alias("limit"), F.first("error").alias("error"))
