"""Percentiles in counting passes against Spark's own buffered ``percentile``."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators.metrics import latency_quantiles

QS = (0.0, 0.5, 0.9, 0.99, 1.0)


@pytest.fixture(scope="module")
def table(spark):
    rnd, rows = random.Random(2), []
    rows += [("hot", None, rnd.gauss(0, 1)) for _ in range(6000)]
    rows += [("ties", 1, float(rnd.choice([1, 1, 1, 2, 7]))) for _ in range(700)]
    rows += [(None, 2, rnd.random() * 1e6) for _ in range(90)] + [("one", 1, 4.25), ("two", 1, 1.0), ("two", 1, 2.0)]
    rows += [("nulls", 1, None)] * 3 + [("some nulls", 1, x) for x in (None, 3.0, None, 5.0)]
    rows += [("nan", 1, float("nan"))] * 4 + [("with nan", 1, x) for x in (1.0, 2.0, float("nan"))]
    return spark.createDataFrame(rows, "a string, b int, v double").repartition(5)


@pytest.mark.parametrize("keys", [["a", "b"], ["a"], []])
def test_quantiles_equal_percentile(table, keys):
    want = table.groupBy(*keys).agg(*[F.round(F.percentile("v", F.lit(q)), 4).alias(f"p{int(q * 100)}") for q in QS])
    assert sorted(map(str, latency_quantiles(table, "v", keys, QS).collect())) == sorted(map(str, want.collect()))


def test_quantiles_of_nothing_and_of_integers(spark, table):
    assert latency_quantiles(table.where("a = 'no such'"), "v", ["a"]).count() == 0
    rows = latency_quantiles(spark.range(1001).withColumn("v", F.col("id").cast("int")), "v", []).collect()
    assert [tuple(r) for r in rows] == [(500.0, 900.0, 990.0)]


def test_no_buffering_aggregate_in_the_plan(table):
    plan = latency_quantiles(table, "v", ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_" not in plan
