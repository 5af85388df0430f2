"""The semantic cache as a partitioned table (A4, A5, A9): append and purge.

Laid out as ``provider_part=/model_part=/batch=``.  Every write goes through Spark's dynamic
partition overwrite: new files are staged beside the table and moved in when the
job commits, so an attempt that is interrupted before leaves the table as it was, and
partitions that a write does not touch keep their files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.cache import append_cache, with_partition_cols
from veilframe.session import written

PARTITION = ("provider_part", "model_part", "batch")


def _swap_in(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)


def append(entries: DataFrame, path: str, batch: str, ttl_col: str = "ttl_seconds") -> None:
    """A4: add the entries whose TTL is positive as one batch.  Entries are not deduplicated, but the same
    batch written again replaces itself, so a retry adds nothing twice."""
    _swap_in(with_partition_cols(append_cache(entries, ttl_col)).withColumn("batch", F.lit(batch)), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table; batch names stay strings."""
    return spark.read.option("recursiveFileLookup", "false").parquet(path).withColumn("batch", F.col("batch").cast("string"))


def purge(spark: SparkSession, path: str, as_of: Column, expires_col: str = "e_expires_ms", before_swap=None) -> int:
    """Drop entries that are not live at ``as_of``; returns how many partitions were touched.

    Only partitions that hold an expired entry are rewritten; one without any live entry is
    removed.  What stays is staged first, ``before_swap()`` is called, then it is moved in: a purge
    stopped before, or between its steps, can simply be run again."""
    table = read(spark, path).withColumn("_live", F.col(expires_col) > as_of)
    # one row per partition with expired entries; their number follows the layout, not the entries
    touched = written(table.groupBy(*PARTITION).agg(F.count_if(~F.col("_live")).alias("gone"), F.count_if("_live").alias("left")).where("gone > 0"), "cache-touched")
    n = touched.count()
    if n == 0:
        return 0
    staged = written(table.where("_live").drop("_live").join(touched.select(*PARTITION), list(PARTITION), "left_semi"), "cache-staged")
    if before_swap is not None:
        before_swap()
    _swap_in(staged, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in touched.where("left = 0").select(*PARTITION).toLocalIterator():
        place = hadoop(path + "".join(f"/{c}={r[c]}" for c in PARTITION))
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    spark.catalog.refreshByPath(path)
    return n
