"""Exact dedup on an extendible-hash index kept in shared files (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import ascii_lower, documents, stored


def _prefix(h: str, bits: int):
    """The leading ``bits`` bits of a 64-bit hash (0 for none)."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(F.col(h), 64 - bits)


def build_directory(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The index's directory: one row per slot (leading ``depth`` bits of the
    hash) with the bucket that owns it.

    A bucket starts as the whole key space; while one holds more than
    ``capacity`` keys the directory doubles and that bucket is split by one more
    bit, the others keep their shorter prefix. The doublings are worked out from
    one histogram at the finest depth: the smallest prefix depth at which a slot's
    bucket fits is its local depth. The finest depth leaves three bits beyond
    an even split; a bucket still overfull there (equal hashes) keeps its chain.
    """
    n = entries.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / capacity)) + 3) if n > capacity else 0
    slots = entries.groupBy(_prefix("h", depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = slots.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "p", F.expr(f"shiftrightunsigned(slot, {depth} - d)"))
    fits = levels.groupBy("d", "p").agg(F.sum("n").alias("bucket_keys")).where(
        (F.col("bucket_keys") <= capacity) | (F.col("d") == depth))
    local = levels.join(fits, ["d", "p"]).groupBy("slot").agg(F.min("d").alias("local_depth"))
    bucket = F.concat_ws("_", F.col("local_depth"), F.expr(f"shiftrightunsigned(slot, {depth} - local_depth)"))
    return local.select("slot", "local_depth", bucket.alias("bucket")), depth


def build_index(keyed: DataFrame, capacity: int = 50_000) -> DataFrame:
    """Index files from rows ``(h, norm, doc_id)``: one entry per distinct text.

    Grouping on (hash, text) compares bytes and combines copies before the
    shuffle, so a hot text is one row per map task. Entries go to the bucket that
    the directory names; each bucket is one owner task and one file, where
    entries of equal hash form a chain.
    """
    entries = stored(
        keyed.groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-entries")
    directory, depth = build_directory(entries, capacity)
    directory = stored(directory, "dedup-directory")
    placed = entries.withColumn("slot", _prefix("h", depth)).join(directory, "slot")
    chained = placed.repartition("bucket").withColumn(
        "chain", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256")))
    return stored(chained.select("h", "text_sha256", "keep_id", "group_size", "chain", "local_depth", "bucket"),
                  "dedup-index", ("bucket",))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = 50_000, hash_bits: int = 64) -> DataFrame:
    """Exact copies of documents, equal when identical after lower-casing A-Z.

    Returns one row per input row: doc_id, keep_id (the largest id of the
    group), group_size, kept, text_sha256, chain (place in the collision chain).

    Null texts count as empty (all of them one group). A null id is smaller
    than any other; a group of null ids only keeps ``keep_id`` null and its rows
    are kept. Rows that repeat both id and text share one verdict. An empty table
    gives an empty result. Only the two named columns are read, so extra columns
    of any name do no harm. ``hash_bits`` below 64 shortens the hash (tests use
    it to force chains).
    """
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    h = F.xxhash64("norm") if hash_bits == 64 else F.shiftleft(
        F.shiftrightunsigned(F.xxhash64("norm"), 64 - hash_bits), 64 - hash_bits)
    keyed = base.withColumn("h", h)
    index = build_index(keyed, capacity)
    rows = keyed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    found = rows.join(index.select("h", "text_sha256", "keep_id", "group_size", "chain"), ["h", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size",
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "chain")


def op1_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP1_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}',
                                           '{'abcdefghijklmnopqrstuvwxyz'}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256, 1 AS chain
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
