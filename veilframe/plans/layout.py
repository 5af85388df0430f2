"""Partition-layout helpers shared by the query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Round-robin a DataFrame over the cluster only when its scan yields
    fewer partitions than there are cores.

    Row-local but CPU-heavy operators (regex scrub, restore, sealing) would
    otherwise run in a single task on a one-row-group file.  On a large input
    the scan already has more splits than cores and nothing is added: no
    shuffle of the big table is ever introduced.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    # hash-partitioning on a row key is deterministic on retry without the
    # local sort that a round-robin repartition performs first
    key = [k for k in keys if k in df.columns]
    return df.repartition(target, *key) if key else df.repartition(target)
