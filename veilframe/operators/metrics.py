"""Request counters, latency histograms and log processing (M1-M8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import written

QUANTILE_BINS = 64  # bins of a group between which its quantiles are looked for

# Latency histogram bucket upper bounds in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)

# Stages that observe the duration histogram.
OBSERVED_STAGES = ("pii_scrub", "cache_lookup", "llm_forward", "total")

# Log level ranks.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def request_counts(df: DataFrame) -> DataFrame:
    """M1: counter by (provider, model, status); streamed responses count
    under status ``stream``."""
    status = F.when(F.col("is_stream"), F.lit("stream")).otherwise(F.col("status").cast("string"))
    return df.groupBy("provider", "model", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(df: DataFrame, value_col: str, group_cols=(), buckets=LATENCY_BUCKETS) -> DataFrame:
    """M2: cumulative ``le`` buckets plus +Inf, sum and count, as rows.

    One aggregate computes every bucket count (``count_if(v <= le)``) in a
    single pass with partial aggregation; ``stack`` turns the columns into
    rows afterwards.  No cross join with a bucket table."""
    v = F.col(value_col)
    aggs = [F.count_if(v <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(v).alias("b_inf"), F.sum(v).alias("v_sum")]
    wide = df.groupBy(*group_cols).agg(*aggs)
    pairs = ", ".join(f"'{b}', b{i}" for i, b in enumerate(buckets)) + ", '+Inf', b_inf"
    stacked = wide.select(*group_cols, F.expr(f"stack({len(buckets) + 1}, {pairs}) AS (le, bucket_count)"),
                          "v_sum", F.col("b_inf").alias("v_count"))
    return stacked


def stage_latency(df: DataFrame, stage_cols: dict[str, str]) -> DataFrame:
    """M3: unpivot per-stage durations and aggregate per stage (a NULL is no observation)."""
    long = df.unpivot([], list(stage_cols.values()), "stage_col", "seconds").where(F.col("seconds").isNotNull())
    names = F.create_map(*[x for k, c in stage_cols.items() for x in (F.lit(c), F.lit(k))])
    return (long.withColumn("stage", names[F.col("stage_col")])
                .groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 6).alias("seconds_sum")))


def latency_quantiles(df: DataFrame, value_col: str, group_cols, qs=(0.5, 0.9, 0.99)) -> DataFrame:
    """M4: exact interpolated percentiles in two counting passes; no buffer grows with a group.

    A KLL sketch per group (bounded, rank error about 1.7 % at its default size) places the cuts of
    QUANTILE_BINS bins. The first pass counts rows per bin, which tells the bins that hold a
    wanted rank; the second counts distinct values in those bins alone, and a running count in value
    order, which Spark sorts and spills, finds the ranks. The sketch only balances the bins: the
    result is exact whatever it says. Its cuts are written once, so both passes see the same ones.

    NULLs are no observations (a group of NULLs alone has NULL percentiles), NaN is the largest
    value, null group keys form a group, an empty table has no rows.
    """
    keys = list(group_cols)
    rows = df.select(F.struct(F.lit(0).alias("_all"), *keys).alias("_g"), F.col(value_col).cast("double").alias("_v"))
    number = F.when(~F.isnan("_v"), F.col("_v"))
    inner = F.array(*[F.lit(i / QUANTILE_BINS) for i in range(1, QUANTILE_BINS)])
    groups = written(rows.groupBy("_g").agg(F.count("_v").alias("_n"), F.count(number).alias("_numbers"), F.kll_sketch_agg_double(number).alias("_s"))
                     .select("_g", "_n", F.when(F.col("_numbers") > 0, F.kll_sketch_get_quantile_double("_s", inner)).alias("_cuts")), "quantile-cuts")
    of = groups.select(F.col("_g").alias("_of"), "_n", "_cuts")
    below = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col("_v")))
    binned = rows.where(F.col("_v").isNotNull()).join(of, F.col("_g").eqNullSafe(F.col("_of"))).select("_g", "_n", "_v", below.alias("_bin"))

    def place(q):
        return F.lit(q) * (F.col("_n") - 1)

    def holds(rank):
        return (rank >= F.col("_at")) & (rank < F.col("_at") + F.col("_c"))

    def running(*by, order):
        return F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranks = F.array(*[r(place(q)) for q in qs for r in (F.floor, F.ceil)])
    bins = (binned.groupBy("_g", "_n", "_bin").agg(F.count(F.lit(1)).alias("_c")).withColumn("_at", running("_g", order="_bin"))
            .where(F.exists(ranks, holds)).select(F.col("_g").alias("_of"), F.col("_bin").alias("_in"), F.col("_at").alias("_base")))
    values = (binned.join(bins, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("_bin") == F.col("_in")))
              .groupBy("_g", "_n", "_bin", "_base", "_v").agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_at", F.col("_base") + running("_g", "_bin", order="_v")))
    ends = [F.max(F.when(holds(r(place(q))), F.col("_v"))).alias(f"_{side}{i}")
            for i, q in enumerate(qs) for side, r in (("lo", F.floor), ("hi", F.ceil))]
    found = values.groupBy(F.col("_g").alias("_of")).agg(*ends)

    def between(i, q):
        lo, hi, at = F.col(f"_lo{i}"), F.col(f"_hi{i}"), place(q)
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return groups.join(found, F.col("_g").eqNullSafe(F.col("_of")), "left").select(
        *[F.col("_g")[k].alias(k) for k in keys], *[F.round(between(i, q), 4).alias(f"p{int(q * 100)}") for i, q in enumerate(qs)])


def label_cardinality(df: DataFrame, labels) -> DataFrame:
    """M5: distinct values per label column (exact), one row per label."""
    wide = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in labels])
    return wide.unpivot([], list(labels), "label", "distinct_values")


def level_rank(level: Column) -> Column:
    ranks = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(ranks, F.upper(level)), F.lit(LEVELS["INFO"]))


def filter_level(logs: DataFrame, level: str, level_col: str = "level") -> DataFrame:
    """M8: keep records at or above ``level``; unknown names count as INFO."""
    threshold = LEVELS.get(level.upper(), LEVELS["INFO"])
    return logs.where(level_rank(F.col(level_col)) >= threshold)


def enrich_logs(logs: DataFrame, requests: DataFrame, key: str = "request_id",
                fields=("trace_id", "org_id")) -> DataFrame:
    """M7: fill context fields a log row lacks from its request (setdefault:
    values already on the log row win)."""
    r = requests.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields])
    j = logs.join(r, key, "left")
    for f in fields:
        j = j.withColumn(f, F.coalesce(F.col(f), F.col(f"_r_{f}"))).drop(f"_r_{f}")
    return j
