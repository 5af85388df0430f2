"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import checkpoint_dir, ship_package
from veilframe.sources.tables import load

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back: later reads do not
    recompute it, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ref(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return load(spark, sf_dir, "documents")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the fast path for pure ASCII; it would
    also change other letters, so any other text goes through ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def running_starts(df: DataFrame, order: str, amount: str, out: str,
                   within: tuple[str, ...] = (), name: str = "starts") -> DataFrame:
    """Exclusive running sum of ``amount`` in ascending ``order`` (per ``within``
    group), without one task seeing a whole group.

    Rows are range-partitioned by ``order`` into numbered blocks and stored;
    sums per (block, group) form a small table whose running total gives every
    block its base, and inside a block an ordinary window does the rest.
    """
    from pyspark.sql import Window

    blocks = stored(df.repartitionByRange(F.col(order).asc_nulls_first())
                    .withColumn("_block", F.spark_partition_id()), name)
    inner = Window.partitionBy("_block", *within).orderBy(F.col(order).asc_nulls_first())
    sums = blocks.groupBy("_block", *within).agg(F.sum(amount).alias("_sum"))
    # one row per (block, group): its size follows the number of blocks, not of rows
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(
        Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = ["_block", *within]
    base = base.select(*[F.col(k).alias(f"_of{k}") for k in keys], "_base")
    joined = blocks.join(base, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys]).select(*blocks.columns, "_base")
    return (joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(
        inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_base", "_block"))
