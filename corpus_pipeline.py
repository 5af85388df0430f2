"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents, ref, stored, unused
from veilframe.llm.line_dedup import line_dedup
from veilframe.llm.packing import pack
from veilframe.llm.pii import mask_pii
from veilframe.llm.simhash import simhash_dedup
from veilframe.llm.toxicity import fit, score_column
from veilframe.session import ship_package
from veilframe.sources.tables import load

ORACLE_SQL = None  # learned scores, edit distances and tokenizers are beyond SQL


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay; null texts count as empty and stay. Repeated rows share a
    score, an empty table stays empty, and columns beside text and doc_id are only carried."""
    ship_package(spark)
    model = fit(docs, load(spark, sf_dir, "labels"))
    return docs.where(score_column(model, F.col("text")) < 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; ``n_chars`` follows the text. A document left without text stays, empty."""
    ship_package(spark)
    counts = tuple(unused(docs.columns, "_dropped", "_lines"))
    kept = line_dedup(docs, short_lines=True, counts=counts)
    return kept.withColumn("n_chars", F.when(F.col(counts[0]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*map(ref, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one document stays: the one with the smallest id, null ids last, and of
    several texts under that id the one of the smallest hash. Of rows that agree in id and
    text one stays. Unrelated texts stay, also under one id or none."""
    ship_package(spark)
    names = unused(docs.columns, "_id", "_no_id", "_row")

    def key(row):
        return [F.coalesce(F.col("doc_id"), F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1]), row.alias(names[2])]

    firsts = simhash_dedup(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group", "doc_id").agg(F.min("row").alias("row"))
    keep = firsts.select(*key(F.col("row")))
    # the join's partitioning serves the grouping that follows
    kept = docs.select(*map(ref, docs.columns), *key(F.xxhash64("text"))).join(keep.hint("merge"), names, "left_semi").dropDuplicates(names)
    return kept.select(*map(ref, docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; ``n_chars`` follows the text."""
    ship_package(spark)
    return mask_pii(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids holding the sources in the corpus's proportions. Null texts are their end id
    alone, repeated rows are packed each, an empty table gives no rows, other columns are not read."""
    import public_tokenizers

    ship_package(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("simhash", near_duplicates), ("pii", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
