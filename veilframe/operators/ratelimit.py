"""Sliding-window rate limiting over request histories.

Semantics of one check at time ``t`` (integer ms) for a key with limit ``L``
and window ``W``: drop admitted entries with ``a <= t - W``; with ``n``
entries left, reject when ``n >= L`` (``current = n``, ``retry_after_ms =
W - (t - oldest)``), else admit and record ``t`` (``current = n + 1``).
Rejected requests are not recorded.  Requests of a key are checked in
``(t, id)`` order.

Admission is path dependent, so it is not a window function.  The plan
works on *runs*: the requests of a key at one millisecond are one row (key, t, n),
combined before the shuffle, and no step partitions requests by key alone (one
key may hold a third of them):

1. Time is cut into buckets of width ``W`` and every run is also copied into
   the next bucket, where it expires again.  Partitioned by (key, bucket), a run
   then sees every run of ``(t - W, t]``, which is all the offered load (E1) and the
   island split need.  Loads are running sums: no frame slides, so a bucket's work
   grows with its runs, not with their square.
2. An *island* starts wherever the gap to the previous run is at least
   ``W``: every earlier entry is evicted there, so the state is provably
   empty.  A run's island is the latest start at or before it, found inside
   its bucket or carried from earlier buckets over a small per-bucket summary.
3. An island whose offered load never exceeds ``L`` admits every request (by
   induction) with no state at all.
4. Only overloaded islands are replayed.  Their runs are packed into one row
   per time block (arrays of times and counts), and a sorted streaming scan
   walks the blocks of an island.  With the window full it jumps to the next
   eviction, so it steps over admitted runs only, and it gives back
   only these: (key, t, how many).  Its memory is one block and at most ``L``
   entries.  A single never-idle overloaded island is sequential by
   definition, but what its task reads and writes are packed runs.
5. The requests themselves are decided by joins: at (key, t) the first ``m`` by
   id are admitted, and a second window over (key, bucket) gives how many entries
   were live and since when.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.replay import admitted_counts
from veilframe.functions.timeutil import epoch_millis
from veilframe.session import written

WINDOW_MS = 3_600_000  # fixed value: one hour

BLOCKS = 8  # time blocks in a window: runs of one block (at most W / 8 of them) are packed into one row


def epoch_ms(ts: Column) -> Column:
    """Integer epoch milliseconds of a wall-clock timestamp read as UTC."""
    return epoch_millis(ts)


def _bucket(t: Column, window_ms: int) -> Column:
    return ((t - F.pmod(t, F.lit(window_ms))) / window_ms).cast("long")


def _with_load(df: DataFrame, key: str, t: str, n: Column, out: str, window_ms: int) -> DataFrame:
    """Add ``out``, the sum of ``n`` over the key's rows of ``(t - W, t]`` (ties at ``t`` included),
    and the row's bucket ``_b``.

    A row counts from its own time on, in its bucket and (as a copy) in the next one, where it
    expires again at ``t + W``: a row-local generator, and one running sum per (key, bucket).  A
    sliding frame would be summed anew for every row, which grows with the square of a bucket."""
    role = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("_role")  # the row, its copy, its end
    # without a time a row stands beside its copy and never expires
    ext = (df.select("*", n.alias("_add"), role).where((F.col("_role") < 2) | F.col(t).isNotNull())
             .withColumn("_b", _bucket(F.col(t), window_ms) + F.when(F.col("_role") > 0, 1).otherwise(0))
             .withColumn("_at", F.col(t) + F.when(F.col("_role") == 2, F.lit(window_ms)).otherwise(0)))
    upto = Window.partitionBy(key, "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (ext.withColumn(out, F.sum(F.when(F.col("_role") == 2, -F.col("_add")).otherwise(F.col("_add"))).over(upto))
               .where(F.col("_role") == 0).drop("_add", "_role", "_at"))


def _with_oldest(df: DataFrame, key: str, t: str, counted: Column, out: str, window_ms: int) -> DataFrame:
    """Add ``out``, the smallest time of the key's ``counted`` rows of ``(t - W, t]`` (null if none).

    Every row asks at ``t - W`` and the counted ones stand at their time, in their bucket and in the
    next one; read backwards, the last one passed is the first after ``t - W``."""
    role = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("_role")  # the question, the row, its copy
    ext = (df.select("*", counted.alias("_counted"), role).where((F.col("_role") == 0) | F.col("_counted"))
             .withColumn("_b", _bucket(F.col(t), window_ms) + F.when(F.col("_role") == 2, 1).otherwise(0))
             .withColumn("_at", F.col(t) - F.when(F.col("_role") == 0, F.lit(window_ms)).otherwise(0)))
    after = Window.partitionBy(key, "_b").orderBy(F.col("_at").desc(), "_role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.when(F.col("_role") > 0, F.col(t))).over(after)
    return (ext.withColumn("_first", first).where(F.col("_role") == 0)
               .withColumn(out, F.when(F.col("_first") <= F.col(t), F.col("_first"))).drop("_counted", "_role", "_b", "_at", "_first"))


def offered_rate(df: DataFrame, key: str, t: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """Requests of the key in ``(t - W, t]`` (ties at ``t`` included),
    computed per (key, bucket) so a hot key spreads over tasks."""
    return _with_load(df, key, t, F.lit(1).cast("long"), "offered", window_ms).drop("_b")


def _runs(df: DataFrame, key: str, t: str, window_ms: int) -> DataFrame:
    """Runs (key, t, _n, _limit) with their offered load and island (the time of its first run)."""
    runs = df.groupBy(key, t).agg(F.count(F.lit(1)).alias("_n"), F.max("_limit").alias("_limit"))
    # a run that carries the whole load has no other one in the window before it
    rows = _with_load(runs, key, t, F.col("_n"), "offered", window_ms).withColumn("_start", F.when(F.col("offered") == F.col("_n"), F.col(t)))
    by_t = Window.partitionBy(key, "_b").orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_in_bucket", F.last("_start", ignorenulls=True).over(by_t))
    # one row per (key, bucket): the last island start inside the bucket,
    # and the start carried in from earlier buckets of the key
    summary = rows.groupBy(key, "_b").agg(F.max("_start").alias("_last"))
    carried = summary.select(key, "_b", F.last("_last", ignorenulls=True).over(
        Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return rows.join(carried, [key, "_b"]).select(key, t, "_n", "_limit", "offered", F.coalesce("_in_bucket", "_carry").alias("_island_t"))


def _replay(key: str, t: str, window_ms: int):
    """Replay for mapInPandas: one row per time block of an island, sorted by (key, island, block)."""
    def run(batches):
        group, live = None, deque()
        for pdf in batches:
            keys, at, ms = [], [], []
            for k, island, times, counts, limits in zip(pdf[key], pdf["_island_t"], pdf["_times"], pdf["_counts"], pdf["_limits"], strict=True):
                k = None if pd.isna(k) else k
                if (k, island) != group:
                    group, live = (k, island), deque()
                for i, m in admitted_counts(times, counts, limits, window_ms, live):
                    keys.append(k)
                    at.append(int(times[i]))
                    ms.append(m)
            yield pd.DataFrame({key: pd.Series(keys, dtype=pdf[key].dtype), t: pd.Series(at, dtype="int64"), "_m": pd.Series(ms, dtype="int64")})
    return run


def admit(df: DataFrame, key: str, t: str, id_col: str, limit: int | str,
          window_ms: int = WINDOW_MS) -> DataFrame:
    """Add ``admitted``, ``current``, ``retry_after_ms`` (0 when
    admitted, or when the limit is 0) and ``offered`` to every request.

    ``limit`` is an integer or the name of a limit column (E5); the requests of a key at one
    millisecond share a limit (the largest counts), over time it may change."""
    lim = F.lit(limit) if isinstance(limit, int) else F.col(limit)
    # the key as a struct equals itself also when it is null, so plain equi-joins and
    # windows over it share one partitioning
    base = df.withColumn("_key", F.struct(F.col(key).alias("k"))).withColumn("_limit", lim.cast("int"))
    # small (one row a key and millisecond) and read three times below
    runs = written(_runs(base, "_key", t, window_ms), "admission-runs")
    over = runs.where(F.col("offered") > F.col("_limit")).select("_key", "_island_t").distinct().withColumn("_over", F.lit(True))
    marked = runs.join(over, ["_key", "_island_t"], "left")
    block = F.floor(F.col(t) / max(1, window_ms // BLOCKS)).cast("long")
    blocks = marked.where("_over").groupBy("_key", "_island_t", block.alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), "_n", "_limit"))).alias("_runs")).select(
        F.col("_key.k").alias(key), "_island_t", "_block", F.col("_runs.t").alias("_times"), F.col("_runs._n").alias("_counts"), F.col("_runs._limit").alias("_limits"))
    kind = df.schema[key].dataType.simpleString()
    taken = (blocks.repartition(key, "_island_t").sortWithinPartitions(key, "_island_t", "_block")
                   .mapInPandas(_replay(key, t, window_ms), f"`{key}` {kind}, `{t}` long, _m long")
                   .select(F.struct(F.col(key).alias("k")).alias("_key"), t, "_m"))
    decided = marked.join(taken, ["_key", t], "left").withColumn(
        "_m", F.when(F.col("_over"), F.coalesce("_m", F.lit(0))).otherwise(F.col("_n")))
    # entries live at a run, its own included, and the oldest of them
    used = _with_load(decided.select("_key", t, "offered", "_m"), "_key", t, F.col("_m").cast("long"), "_used", window_ms).drop("_b")
    states = _with_oldest(used, "_key", t, F.col("_m") > 0, "_oldest", window_ms)
    ranked = base.drop("_limit").withColumn("_rank", F.row_number().over(Window.partitionBy("_key", t).orderBy(id_col)))
    ok = F.col("_rank") <= F.col("_m")
    return ranked.join(states, ["_key", t]).select(
        *df.columns, "offered", ok.alias("admitted"),
        F.when(ok, F.col("_used") - F.col("_m") + F.col("_rank")).otherwise(F.col("_used")).cast("int").alias("current"),
        F.when(ok | F.col("_oldest").isNull(), F.lit(0)).otherwise(F.lit(window_ms) - (F.col(t) - F.col("_oldest"))).cast("long").alias("retry_after_ms"))


def retry_after_seconds(ms: Column) -> Column:
    """Header value: whole seconds, at least 1."""
    return F.greatest(F.lit(1), F.floor(ms / 1000)).cast("long")


def rejections(admitted: DataFrame, limit: int | str) -> DataFrame:
    """One report row per rejected request."""
    lim = F.lit(limit) if isinstance(limit, int) else F.col(limit)
    return admitted.where(~F.col("admitted")).withColumn("error", F.lit("RATE_LIMITED")).withColumn(
        "limit", lim.cast("int"))
