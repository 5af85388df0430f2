"""Append and purge of the cache table, interrupted attempts included."""

import os

import pytest
from pyspark.sql import functions as F

from veilframe.sources import cache_table as CT

ROWS = [(i, p, m, 60 if i % 7 else 0, 1000 + i * 10) for i, (p, m) in enumerate([("openai", "gpt-4o"), ("openai", "other-1"), ("gemini", "gemini-1.5-pro")] * 20)]
SCHEMA = "e_id long, provider string, model string, ttl_seconds int, e_expires_ms long"


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "/." not in d and "_temporary" not in d}


def ids(spark, path):
    return sorted(r["e_id"] for r in CT.read(spark, path).select("e_id").collect())


def test_append_retry_and_purge(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame(ROWS, SCHEMA)
    CT.append(df.where("e_id < 30"), path, "a")
    CT.append(df.where("e_id >= 30"), path, "b")
    before = files(path)
    CT.append(df.where("e_id >= 30"), path, "b")  # a retry
    want = [i for i, _, _, ttl, _ in ROWS if ttl > 0]
    assert ids(spark, path) == want
    assert {f for f in before if "batch=a" in f} <= files(path)
    # everything of batch "a" expires: its partitions go, those of "b" keep their files
    kept = {f for f in files(path) if "batch=b" in f}
    assert CT.purge(spark, path, F.lit(1000 + 29 * 10)) == 3
    assert ids(spark, path) == [i for i in want if i >= 30] and files(path) == kept
    assert CT.purge(spark, path, F.lit(0)) == 0


def test_a_purge_stopped_before_its_swap(spark, tmp_path):
    path = str(tmp_path / "cache")
    CT.append(spark.createDataFrame(ROWS, SCHEMA), path, "a")
    before, had = files(path), ids(spark, path)

    def stop():
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        CT.purge(spark, path, F.lit(1300), before_swap=stop)
    assert files(path) == before and ids(spark, path) == had
    CT.purge(spark, path, F.lit(1300))
    assert ids(spark, path) == [i for i, _, _, ttl, x in ROWS if ttl > 0 and x > 1300]
