"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import stored
from veilframe.session import ship_package
from veilframe.sources.tables import load

K = 20
EPSILON = 2.5            # half-width of the bounds, in standard errors of an estimate
BLOCK_VALUES = 1 << 18   # numbers in a block of vectors
FIRST = 64               # best estimates scored exactly to set the threshold


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; the largest component is taken out before squaring, so
    only a length beyond the doubles is infinite, and no direction is lost."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    lengths = np.sqrt((scaled * scaled).sum(axis=1))
    with np.errstate(over="ignore"):
        return scaled / lengths[:, None], lengths * largest[:, 0]


def encode_block(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors; correction scalars: the length
    over the code's agreement with its vector, and the error's scale."""
    dim = vectors.shape[1]
    unit, norms = directions(vectors)
    turned = unit.astype(np.float32) @ rotation(dim)
    agree = np.minimum(np.abs(turned).sum(axis=1) / np.sqrt(dim), 1.0)  # inner product of code and vector
    error = norms * np.sqrt((1 - agree**2) / agree**2 / max(1, dim - 1))
    return np.packbits(turned > 0, axis=1), norms / agree, error


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in component order."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.cumsum(vectors * query, axis=1)[:, -1]


def search_block(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray,
                 scale: np.ndarray, error: np.ndarray, k: int) -> list[tuple]:
    """The k best of a block for each query (query_id, vec_id, score).

    All inner products are estimated from the codes; the best few estimates are
    scored exactly, and with their k-th score as threshold only vectors whose upper bound
    reaches it are scored as well. Estimates are of the query's direction, in doubles, as
    lengths may differ by any power; a vector whose product with the query may leave the doubles
    is always scored. A score that is no number ranks first, as Spark and SQL order it.
    """
    dim = vectors.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    out = []
    for i in range(0, len(queries), 256):
        some = queries[i:i + 256]
        units, lengths = directions(some)
        agreement = (units.astype(np.float32) @ rotation(dim)) @ signs.T
        for q, qid, agrees, length in zip(some, query_ids[i:i + 256], agreement, lengths, strict=True):
            with np.errstate(over="ignore", invalid="ignore"):
                est = agrees * (scale / np.sqrt(dim))
                upper = (est + EPSILON * error) * length
                unsafe = ~np.isfinite(length * scale * dim)
            est[ids == qid] = -np.inf
            first = np.argpartition(-est, FIRST)[:FIRST] if len(est) > FIRST else np.arange(len(est))
            first = first[ids[first] != qid]
            scores = np.nan_to_num(exact(vectors[first], q), nan=np.inf, posinf=np.inf, neginf=-np.inf)
            least = np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf
            found = np.flatnonzero(((upper >= least) | unsafe) & (ids != qid))
            found = np.union1d(found, first)
            scores = exact(vectors[found], q)
            best = np.lexsort((ids[found], -scores, ~np.isnan(scores)))[:k]
            out += zip([qid] * len(best), ids[found[best]], scores[best], strict=True)
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors that are neither null nor zero, with finite components only."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            block_values: int = BLOCK_VALUES) -> DataFrame:
    """The k nearest other rows of every query row: query_id, rank, vec_id, score.

    Nearness is the largest inner product; ties go to the smaller id. Every usable
    vector is coded and compared with every query, block by block: a task holds one block
    of vectors and one of queries, and a hot vector value is only more rows. Null, zero
    and non-finite vectors and rows without an id take no part; vectors of other lengths are
    never compared. Rows that repeat an id are candidates each, but not of that id's query. An
    empty table gives an empty result. Only the two named columns are read.
    """
    rows = stored(usable(vectors, id_col, vector_col).withColumn("dim", F.size("v")), "ann-vectors")
    size = rows.agg(F.sum("dim")).first()[0] or 0
    blocks = max(1, -(-size // block_values))
    queries = rows.where(is_query(F.col("vec_id")))
    q_size = queries.agg(F.sum("dim")).first()[0] or 0
    q_blocks = max(1, -(-q_size // block_values))

    def code(b: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(b["v"])
        bits, scale, error = encode_block(m)
        return pd.DataFrame({"dim": [m.shape[1]], "block": [b["block"].iloc[0]], "ids": [b["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [m.tobytes()],
                             "codes": [bits.tobytes()], "scale": [scale.tobytes()], "error": [error.tobytes()]})

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [len(b["v"].iloc[0])], "q_block": [b["q_block"].iloc[0]], "ids": [b["vec_id"].to_numpy(np.int64).tobytes()],
                             "vectors": [_matrix(b["v"]).tobytes()]})

    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    coded = stored(rows.withColumn("block", number).groupBy("dim", "block").applyInPandas(
        code, "dim int, block int, ids binary, vectors binary, codes binary, scale binary, error binary"), "ann-codes")
    q_number = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(q_blocks)).cast("int")
    packed = stored(queries.withColumn("q_block", q_number).groupBy("dim", "q_block").applyInPandas(
        pack, "dim int, q_block int, ids binary, vectors binary"), "ann-queries")

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            q, c = q.iloc[0], c.iloc[0]
            ids, q_ids = np.frombuffer(c["ids"], np.int64), np.frombuffer(q["ids"], np.int64)
            found = search_block(np.frombuffer(q["vectors"]).reshape(len(q_ids), -1), q_ids, ids, np.frombuffer(c["vectors"]).reshape(len(ids), -1),
                                 np.frombuffer(c["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(c["scale"]), np.frombuffer(c["error"]), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    asked = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = coded.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    keys = ["dim", "block", "q_block"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("score", F.coalesce("score", F.lit(float("nan"))))  # pandas hands "no number" over as null
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark, sf_dir) -> DataFrame:
    ship_package(spark)
    return nearest(load(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""
