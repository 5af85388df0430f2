"""Connected components over an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(r)


def component_labels(pairs: DataFrame) -> DataFrame:
    """(node, label) for every node of ``pairs`` (a, b); label is the smallest
    node of its component.

    Each round hangs every neighbourhood below its smallest node, first the
    larger neighbours, then the smaller ones (large star, small star); rounds
    grow with the logarithm of the component size. Minima are combined before the
    shuffle, and every round is a stored table, so no lineage builds up.
    """
    edges = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "cc")
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        # large star: every larger neighbour joins the smallest of the closed neighbourhood
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours and the node itself join the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(hung.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
