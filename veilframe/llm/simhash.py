"""SimHash near-dedup: segment-popcount embedding, grid range join, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import documents, ref, stored
from veilframe.llm.components import component_labels

SHINGLE, MAX_BITS, SEED = 3, 3, 42
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles (unsigned)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n]
    stops = (ends - 1)[-n:] if len(words) >= shingle else ends[-1:] - 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        hs = [digest(buf[s:e], SEED) for s, e in zip(starts[i:i + CHUNK].tolist(), stops[i:i + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hs, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp) for every row; row is the text's hash, fp a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(fp.view(np.int64))], names=["doc_id", "row", "fp"])

    text = ref(text_col).cast("string")
    docs = docs.select(ref(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    return docs.mapInArrow(run, "doc_id long, row long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embed(fp: str = "fp"):
    """The popcounts of the 32 two-bit segments, each in unary (00, 01, 11).

    In this form the Manhattan distance of two count vectors is the number of
    differing bits of their codes; it never exceeds the fingerprints' distance.
    """
    low = 0x5555555555555555
    a, b = F.col(fp), F.shiftrightunsigned(F.col(fp), 1)
    one = a.bitwiseOR(b).bitwiseAND(F.lit(low))
    two = F.shiftleft(a.bitwiseAND(b).bitwiseAND(F.lit(low)), 1)
    return one.bitwiseOR(two)


def grid_masks(max_bits: int = MAX_BITS) -> list[int]:
    """Bit masks of the grid's cells: the 32 segments fall into ``2 * max_bits``
    blocks, and vectors within Manhattan distance ``max_bits`` agree on at least
    half of the blocks, so on all of one ``max_bits``-subset."""
    blocks = max(2, 2 * max_bits)
    parts = np.array_split(np.arange(32), blocks)
    full = [sum(3 << int(2 * s) for s in p) for p in parts]
    keep = blocks - max_bits
    return [_signed(sum(c)) for c in combinations(full, keep)]


def near_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints at ``max_bits`` or fewer differing bits.

    Each fingerprint enters one grid cell per mask: an equi-join on (mask number,
    cell), with the Manhattan bound and the exact distance checked inside the join.
    A pair is reported only in the first mask on which it agrees.
    """
    masks = grid_masks(max_bits)
    cells = fps.select("fp", embed().alias("u")).withColumn(
        "cell", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("u").bitwiseAND(F.lit(m)).alias("key"))
                                    for i, m in enumerate(masks)]))).select("cell.m", "cell.key", "fp", "u")
    a = cells.select("m", "key", F.col("fp").alias("a"), F.col("u").alias("ua"))
    b = cells.select("m", "key", F.col("fp").alias("b"), F.col("u").alias("ub"))
    differ = F.col("ua").bitwiseXOR(F.col("ub"))
    cond = ((a["m"] == b["m"]) & (a["key"] == b["key"]) & (F.col("a") < F.col("b"))
            & (F.bit_count(differ) <= max_bits)
            & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    return a.join(b, cond & (a["m"] == first)).select("a", "b")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Near-duplicate groups: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable over links), n_links (of its fingerprint, to other fingerprints),
    row (hash of the text) and group (names the component even where ids repeat or are null).

    Null texts count as empty; texts without words have fingerprint zero and are
    linked like any other. Null ids keep their row; a component of null ids only has a null
    component_id. Repeated rows share a fingerprint, hence a component. An empty
    table gives an empty result; only the two named columns are read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    pairs = stored(near_pairs(nodes, max_bits), "simhash-pairs")
    labels = component_labels(pairs)
    root = F.coalesce(F.col("label"), F.col("fp"))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", root.alias("root"))
    tops = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    classes = stored(named.join(tops, "root").join(degree, "fp", "left")
                     .select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("root").alias("group")), "simhash-classes")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links", "row", "group")


def op2_simhash(spark, sf_dir) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))
