"""Semantic cache operators.

Exact nearest-neighbour lookup is a *blocked matrix product*: queries and
entries of one (org, provider, model) block are cut into chunks of at most
``chunk`` vectors; every (query-chunk, entry-chunk) pair of a block meets
once in a ``cogroup`` and numpy scores the whole chunk pair with one matrix
product.  Only the per-chunk winner of each query (or, for the similarity
join, the pairs above the threshold) leaves the task; a final ``max_by``
aggregate per query picks the global winner.  Groups are bounded by the chunk
size whatever the block size, so a hot block becomes many tasks, and no
candidate pair is ever materialised as a row.  The similarity join writes the
nonzero components of distinct vectors once; of a large block, tasks read them
where they lie, so its disk follows the rows and only its time their square.

Approximate lookup (LSH, D10) is the Spark ML ``BucketedRandomProjectionLSH``
similarity join.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import scratch_path, written
from veilframe.sources.domain import PREWARMED

DEFAULT_THRESHOLD = 0.92  # fixed value: default cosine similarity threshold
DEFAULT_TTL_SECONDS = 86400  # fixed value: default cache TTL
BLOCK = ("org_id", "provider", "model")
CHUNK = 2048
TILE = 16_384         # vectors on a side of a tile of the similarity join
STEP = 1024           # vectors of a file that meet a tile's side at a time
WIDE = 2048           # rows of the side that they meet at a time
STRIP = 512           # pairs decided at a time
OFTEN = 8             # vectors met at a time from which one counts as near many
DENSE = 64            # products that cost less than to fetch the rows of a pair
RUN = 16              # files that a task reads beside its own
AXES = 384            # components by which pairs are ruled out
SEEN = 1 << 20        # vectors that a task remembers
MEMBERS = 65_536      # rows that share one copy of their vector
PAIRS = 1 << 18       # pairs of ids handed on at a time
FLOAT32_ROOM = 1e-3   # rounding of a float32 product of unit vectors is far below it


# ---------------------------------------------------------------------------
# column helpers
# ---------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """D3: L2 normalisation (so cosine = dot)."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / n)


def with_normalized(df: DataFrame, col: str, out: str) -> DataFrame:
    """D3 as a staged projection: the norm is its own column, so the
    per-component lambda reads a value instead of re-summing the vector for
    every component."""
    return (df.withColumn("_norm", F.when(F.spark_partition_id() >= 0, norm(F.col(col))))
              .withColumn(out, F.transform(col, lambda x: x.cast("double") / F.col("_norm"))).drop("_norm"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision."""
    return dot(a, b) / (norm(a) * norm(b))


def quantize(v: Column, digits: int = 7) -> Column:
    """Round every component to ``digits`` decimals (half up, computed in
    double arithmetic so every engine gets the same bits)."""
    scale = float(10 ** digits)
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale + 0.5) / scale)


def prompt_hash(text: Column) -> Column:
    """SHA-256 hex of the UTF-8 text."""
    return F.sha2(text, 256)


def partition_name(x: Column) -> Column:
    """A5: identifier-safe partition suffix."""
    return F.lower(F.translate(x, "-.:", "___"))


def with_partition_cols(df: DataFrame) -> DataFrame:
    """A5: provider leaf and model leaf; pairs not pre-warmed land in the
    provider's ``default`` leaf.  The known-pair table is a fixed 8 rows."""
    known = df.sparkSession.createDataFrame(list(PREWARMED), "provider string, model string").withColumn("_known", F.lit(True))
    j = df.join(F.broadcast(known), ["provider", "model"], "left")
    return (j.withColumn("provider_part", partition_name(F.col("provider")))
             .withColumn("model_part", F.when(F.col("_known"), partition_name(F.col("model"))).otherwise(F.lit("default")))
             .drop("_known"))


# ---------------------------------------------------------------------------
# policy and tables
# ---------------------------------------------------------------------------
def with_effective_cache_policy(orgs: DataFrame) -> DataFrame:
    """Threshold uses a falsy fallback (NULL or 0.0 -> default); TTL a
    NULL fallback (0 stays 0 and disables the cache)."""
    t = F.col("cache_similarity_threshold")
    return (orgs.withColumn("effective_threshold", F.when(t.isNull() | (t == 0), F.lit(DEFAULT_THRESHOLD)).otherwise(t))
                .withColumn("effective_ttl", F.coalesce(F.col("cache_ttl_seconds"), F.lit(DEFAULT_TTL_SECONDS))))


def cacheable(df: DataFrame, stream_col="is_stream", ttl_col="effective_ttl") -> DataFrame:
    """Lookups happen only for non-streaming requests with ttl > 0."""
    return df.where(~F.col(stream_col) & (F.col(ttl_col) > 0))


def append_cache(entries: DataFrame, ttl_col: str = "ttl_seconds") -> DataFrame:
    """A4: TTL <= 0 writes nothing; plain append (no dedup)."""
    return entries.where(F.col(ttl_col) > 0)


def live(entries: DataFrame, as_of: Column) -> DataFrame:
    """An entry is live iff ``expires_at > as_of`` (strict)."""
    return entries.where(F.col("expires_at") > as_of)


# ---------------------------------------------------------------------------
# blocked exact similarity
# ---------------------------------------------------------------------------
def _chunked(df: DataFrame, block: list[str], id_col: str, side: str, chunk: int) -> DataFrame:
    """Attach ``_chunk`` (hash of the id modulo the block's chunk count) and
    ``_n_<side>`` (the block's chunk count on this side)."""
    sizes = df.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"))
    sizes = sizes.withColumn(f"_n_{side}", F.greatest(F.lit(1), F.ceil(F.col("_rows") / chunk)).cast("int")).drop("_rows")
    out = df.join(sizes, block, "inner")
    return out.withColumn("_chunk", F.pmod(F.xxhash64(F.col(id_col)), F.col(f"_n_{side}")).cast("int"))


def _replicate(q: DataFrame, e: DataFrame, block: list[str]):
    """Give every query row one copy per entry chunk of its block and every
    entry row one copy per query chunk, keyed by (block, q_chunk, e_chunk)."""
    nq = q.select(*block, "_n_q").distinct()
    ne = e.select(*block, "_n_e").distinct()
    qx = (q.join(ne, block, "inner")
           .withColumn("_qc", F.col("_chunk"))
           .withColumn("_ec", F.explode(F.sequence(F.lit(0), F.col("_n_e") - 1))))
    ex = (e.join(nq, block, "inner")
           .withColumn("_ec", F.col("_chunk"))
           .withColumn("_qc", F.explode(F.sequence(F.lit(0), F.col("_n_q") - 1))))
    return qx, ex


def _matrix(pdf: pd.DataFrame, col: str) -> np.ndarray:
    if len(pdf) == 0:
        return np.zeros((0, 0))
    m = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[col].to_numpy()])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def _best_fn(threshold_col: str):
    """cogroup function: for each query of the chunk the best live entry of
    the entry chunk (sim desc, created_at desc, id asc) if it reaches the
    query's threshold."""
    def fn(qp: pd.DataFrame, ep: pd.DataFrame) -> pd.DataFrame:
        cols = {"query_id": pd.Series([], dtype="int64"), "entry_id": pd.Series([], dtype="int64"),
                "similarity": pd.Series([], dtype="float64"), "entry_created_ms": pd.Series([], dtype="int64")}
        if len(qp) == 0 or len(ep) == 0:
            return pd.DataFrame(cols)
        qm, em = _matrix(qp, "q_vec"), _matrix(ep, "e_vec")
        sim = qm @ em.T
        q_ts = qp["q_ts_ms"].to_numpy()[:, None]
        e_c = ep["e_created_ms"].to_numpy()[None, :]
        e_x = ep["e_expires_ms"].to_numpy()[None, :]
        ok = (e_c <= q_ts) & (q_ts < e_x) & (sim >= qp[threshold_col].to_numpy()[:, None])
        s = np.where(ok, sim, -np.inf)
        best = s.max(axis=1)
        has = np.isfinite(best)
        if not has.any():
            return pd.DataFrame(cols)
        # tie-break among equal best similarities: newest, then lowest id
        tie = (s == best[:, None]) & ok
        created = np.where(tie, e_c, np.iinfo(np.int64).min)
        newest = created.max(axis=1)
        tie &= created == newest[:, None]
        ids = np.where(tie, ep["e_id"].to_numpy()[None, :], np.iinfo(np.int64).max)
        pick = ids.argmin(axis=1)
        rows = np.nonzero(has)[0]
        return pd.DataFrame({
            "query_id": qp["q_id"].to_numpy()[rows].astype("int64"),
            "entry_id": ep["e_id"].to_numpy()[pick[rows]].astype("int64"),
            "similarity": best[rows].astype("float64"),
            "entry_created_ms": e_c[0, pick[rows]].astype("int64"),
        })
    return fn


def nearest_entries(queries: DataFrame, entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(query_id, entry_id, similarity) for the queries that hit; see
    ``cache_lookup``."""
    block = list(BLOCK)
    q = _chunked(queries, block, "q_id", "q", chunk)
    e = _chunked(entries, block, "e_id", "e", chunk)
    qx, ex = _replicate(q, e, block)
    keys = block + ["_qc", "_ec"]
    qx = qx.select(*keys, "q_id", "q_vec", "q_ts_ms", "threshold")
    ex = ex.select(*keys, "e_id", "e_vec", "e_created_ms", "e_expires_ms")
    partial = qx.groupBy(*keys).cogroup(ex.groupBy(*keys)).applyInPandas(
        _best_fn("threshold"), "query_id long, entry_id long, similarity double, entry_created_ms long")
    best = partial.groupBy("query_id").agg(F.max_by(
        F.struct("entry_id", "similarity"),
        F.struct(F.col("similarity"), F.col("entry_created_ms"), -F.col("entry_id"))).alias("b"))
    return best.select("query_id", F.col("b.entry_id").alias("entry_id"), F.col("b.similarity").alias("similarity"))


def cache_lookup(queries: DataFrame, entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """For each query the nearest live entry of its own block that
    reaches the query's threshold, else a miss.

    ``queries(q_id, org_id, provider, model, q_vec, q_ts_ms, threshold)``,
    ``entries(e_id, org_id, provider, model, e_vec, e_created_ms, e_expires_ms)``.
    Returns every query with ``entry_id`` / ``similarity`` (NULL on miss).

    "Nearest, then threshold" equals "nearest among those reaching the
    threshold" whenever it is a hit, so entries below the threshold are
    dropped inside the chunk product."""
    best = nearest_entries(queries, entries, chunk)
    return (queries.join(best, queries["q_id"] == best["query_id"], "left")
                   .select(*queries.columns, best["entry_id"], best["similarity"]))


def _packed(vectors: pd.Series) -> pd.Series:
    """A vector as the places (int32) and values (float64) of its nonzero components, shared by
    equal vectors; null where a component is missing or not finite, which is similar to nothing."""
    def pack(v):
        if v is None:
            return None
        v = np.asarray(v, dtype=np.float64)
        at = np.flatnonzero(v)
        return at.astype("<i4").tobytes() + v[at].astype("<f8").tobytes() if np.isfinite(v[at]).all() else None
    return vectors.map(pack)


def _unit_rows(packed, at: np.ndarray, dim: int) -> np.ndarray:
    """The packed vectors at some places as a dense matrix of unit rows (a zero vector stays zero)."""
    m = np.zeros((len(at), dim))
    for i, k in enumerate(at.tolist()):
        b = packed[k].as_buffer()
        n = len(b) // 12
        v = np.frombuffer(b, "<f8", n, 4 * n)
        m[i, np.frombuffer(b, "<i4", n)] = v / (np.linalg.norm(v) or 1.0)
    return m


def _dim(packed) -> int:
    return max((int(np.frombuffer(b, "<i4", 1, 4 * (len(b) // 12 - 1))[0]) + 1 for b in (x.as_buffer() for x in packed if x.is_valid) if len(b)), default=1)


class _Side:
    """One side of a tile: the distinct vectors of some rows as unit rows, and the ids that share each.
    Rows of one ``gid`` are of one vector, and one of them holds it."""

    def __init__(self, gids: np.ndarray, ids: np.ndarray, packed, dim: int):
        order = np.lexsort((packed.is_null().to_numpy(), gids))
        self.starts = np.flatnonzero(np.diff(gids[order], prepend=-1))
        self.ids, self.counts = ids[order], np.diff(self.starts, append=len(order))
        self.dim = max(dim, _dim(packed))
        self.rows = _unit_rows(packed, order[self.starts], self.dim)

    def widened(self, dim: int) -> None:
        """What the vectors lack is zero."""
        if dim > self.dim:
            self.rows, self.dim = np.pad(self.rows, ((0, 0), (0, dim - self.dim))), dim

    def bounds(self, axes: np.ndarray) -> np.ndarray:
        """The components on ``axes``, and the length of the rest: by Cauchy-Schwarz the product of two
        such rows is at least the product of the vectors."""
        some = self.rows[:, axes].astype(np.float32)
        if len(axes) >= self.dim:
            return some
        rest = np.einsum("ij,ij->i", self.rows, self.rows) - np.einsum("ij,ij->i", some, some, dtype=np.float64)
        return np.column_stack([some, np.sqrt(np.maximum(rest, 0)).astype(np.float32)])


def _axes(left: _Side) -> np.ndarray:
    """The ``AXES`` components that hold most of the vectors."""
    return np.argsort(-np.einsum("ij,ij->j", left.rows, left.rows), kind="stable")[:AXES]


def _near(left: _Side, right: _Side, first: np.ndarray, axes: np.ndarray, threshold: float, after: int | None):
    """Places of near vectors on either side and their similarity, by strips.  The bounds (in float32, with room
    for its rounding) pick candidates, their own components in float64 decide.  On a diagonal the right side's
    places begin at the left side's place ``after``, a pair comes once, and a vector meets itself if
    several rows hold it."""
    second = right.bounds(axes).T
    least = np.float32(threshold - FLOAT32_ROOM)
    for lo in range(0, len(first), WIDE):
        i, j = np.divmod(np.flatnonzero((first[lo:lo + WIDE] @ second).ravel() >= least), second.shape[1])
        i += lo
        if after is not None:
            once = (i < j + after) | ((i == j + after) & (left.counts[i] > 1))
            i, j = i[once], j[once]
        often = np.bincount(i)[i] >= OFTEN if len(i) else np.zeros(0, bool)
        for some in (often, ~often):
            x, y = i[some], j[some]
            for x, y, sim in _similarities(left, right, x, y):
                ok = sim >= threshold
                yield x[ok], y[ok], sim[ok]


def _similarities(left: _Side, right: _Side, x: np.ndarray, y: np.ndarray):
    """Of pairs of places, by one product if the pairs are a good part of all that their places make."""
    (xu, xi), (yu, yi) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
    if len(xu) * len(yu) <= DENSE * len(x):
        yield x, y, (left.rows[xu] @ right.rows[yu].T)[xi, yi]
    else:
        for at in range(0, len(x), STRIP):
            part = slice(at, at + STRIP)
            yield x[part], y[part], np.einsum("ij,ij->i", left.rows[x[part]], right.rows[y[part]])


def _id_pairs(left: _Side, right: _Side, found, after: int | None):
    """Pairs of ids (a < b) whose vectors were found, so many at a time."""
    for x, y, sim in _gathered(found):
        m, n = left.counts[x], right.counts[y]
        ends = np.cumsum(m * n)
        for lo in range(0, int(ends[-1]), PAIRS):
            flat = np.arange(lo, min(lo + PAIRS, ends[-1]))
            p = np.searchsorted(ends, flat, side="right")
            k = flat - (ends - m * n)[p]
            a, b = left.ids[left.starts[x[p]] + k // n[p]], right.ids[right.starts[y[p]] + k % n[p]]
            # two rows of one vector meet in both orders, rows of two vectors once
            ok = a != b if after is None else np.where(x[p] == y[p] + after, a < b, a != b)
            a, b, p = a[ok], b[ok], p[ok]
            yield pd.DataFrame({"a_id": np.minimum(a, b), "b_id": np.maximum(a, b), "similarity": sim[p]})


def _gathered(found):
    """What was found, in larger pieces."""
    parts, n = [], 0
    for part in found:
        parts.append(part)
        n += len(part[0])
        if n >= PAIRS:
            yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))
            parts, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _tile_pairs(left: _Side, right: _Side, first: np.ndarray, axes: np.ndarray, threshold: float, after: int | None):
    return _id_pairs(left, right, _near(left, right, first, axes, threshold, after), after)


def _pairs_fn(threshold: float):
    """Pairs of one tile whose sides were shipped."""
    def fn(qp: pd.DataFrame, ep: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a_id": np.zeros(0, "int64"), "b_id": np.zeros(0, "int64"), "similarity": np.zeros(0)})]
        if len(qp) and len(ep):
            left, right = (_Side(s["gid"].to_numpy(), s["id"].to_numpy(), pa.chunked_array([pa.array(s["vec"], pa.binary())]), 1) for s in (qp, ep))
            left.widened(right.dim)
            right.widened(left.dim)
            axes = _axes(left)
            # on the diagonal both sides hold the same rows, in order of their gid
            found += _tile_pairs(left, right, left.bounds(axes), axes, threshold, 0 if qp["_i"].iloc[0] == qp["_j"].iloc[0] else None)
        return pd.concat(found)
    return fn


def _sides(uri: str, dim: int, size: int):
    """The rows of a file in the shared folder, by sides of about ``size`` vectors, each with how many came before."""
    def side(table):
        # rows of one vector follow each other, the first of them holds it
        return _Side(np.cumsum(table["vec"].is_valid().to_numpy()), table["id"].to_numpy(), table["vec"], dim)

    fs, path = FileSystem.from_uri(uri)
    done, rest, held = 0, None, 0
    with fs.open_input_file(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(STEP, columns=["id", "vec"]):
            rest = pa.concat_tables([*([] if rest is None else [rest]), pa.Table.from_batches([batch])])
            held += len(batch) - batch["vec"].null_count
            if held > size:
                last = int(np.flatnonzero(rest["vec"].is_valid().to_numpy())[-1])
                yield side(rest.slice(0, last)), done
                done, rest, held = done + held - 1, rest.slice(last), 1
    if held:
        last, rest = side(rest), None  # not kept while the side is used
        yield last, done


def _file_pairs_fn(threshold: float):
    """Pairs of the vectors of a file with those of others, which are read where they are."""
    def fn(units):
        for unit in units:
            for own, others in zip(unit["_file"], unit["_files"], strict=True):
                for left, done in _sides(own, 1, TILE + TILE // 8):
                    axes = _axes(left)
                    first = left.bounds(axes)
                    for other in sorted(others):
                        for right, before in _sides(other, left.dim, STEP):
                            if right.dim > left.dim:
                                left.widened(right.dim)
                                axes = _axes(left)
                                first = left.bounds(axes)
                            right.widened(left.dim)
                            yield from _tile_pairs(left, right, first, axes, threshold, before - done if own == other else None)
                    left = right = first = None
        pa.default_memory_pool().release_unused()  # the worker lives on
    return fn


def _tiles(groups: DataFrame, block: list[str], chunk: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of every tile (_i <= _j) of a block: a vector of chunk c goes to the tiles (c, j) and
    (i, c), once per chunk of its block and once more."""
    placed = _chunked(groups, block, "gid", "g", chunk)
    key = [*[F.col(b).alias(b) for b in block], "_i", "_j"]
    last = F.col("_n_g") - 1
    rows = placed.withColumn("_i", F.col("_chunk")).withColumn("_j", F.explode(F.sequence(F.col("_chunk"), last)))
    columns = placed.withColumn("_j", F.col("_chunk")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_chunk"))))
    held = [c for c in ("gid", "id", "vec") if c in groups.columns]
    return rows.select(*key, *held), columns.select(*key, *[F.col(c).alias(c) for c in held])


def _packed_once(series: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Packed vectors and their hashes; of equal ones of a block only the first of a task is handed on whole."""
    seen: set = set()
    for vectors, blocks in series:
        packed, hashes, whole = _packed(vectors), [], []
        for v, block in zip(packed, blocks, strict=True):
            same = None if v is None else hashlib.sha256(v).digest()
            hashes.append(same)
            whole.append(None if (same, block) in seen else v)
            if len(seen) < SEEN:
                seen.add((same, block))
        yield pd.DataFrame({"same": hashes, "vec": whole})


def _dealt(df: DataFrame, id_col: str, vec_col: str, block: list[str], chunk: int) -> DataFrame:
    """The rows of a similarity join, written once: ``gid`` numbers the distinct vectors of a block, the rows of one
    lie together, and the first of them (of every ``MEMBERS``) holds the vector.

    A block of over ``chunk`` / 8 rows is numbered (``_b``) and dealt by hash to chunks of about ``chunk`` rows
    (``_part``), a file each; the rows of the other blocks have -1 there."""
    spark = df.sparkSession
    once = F.pandas_udf(_packed_once, "same binary, vec binary").asNondeterministic()
    kept = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).dropna(subset=block)
    packed = kept.select(*block, F.col(id_col).cast("long").alias("id"), once(F.col(vec_col).cast("array<double>"), F.to_json(F.struct(*block))).alias("_p")).select(
        *block, "id", F.col("_p.same").alias("_same"), F.col("_p.vec").alias("vec")).where("_same is not null")
    sizes = df.dropna(subset=block).groupBy(*block).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > chunk // 8)
    # at most a row for each chunk / 8 rows of the table
    large = written(sizes.select(*block, F.monotonically_increasing_id().alias("_b"), F.ceil(F.col("_rows") / chunk).cast("int").alias("_n")), "pair-blocks")
    chunks = large.agg(F.sum("_n")).first()[0] or 0
    placed = packed.join(F.broadcast(large), block, "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64("_same"), F.col("_n")), F.lit(-1)).cast("int")).withColumn("_b", F.coalesce("_b", F.lit(-1)).cast("long"))
    dealt = placed.repartition(max(chunks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *block, "_part").withColumn("_row", F.monotonically_increasing_id())
    same = Window.partitionBy("_b", "_part", *block, "_same").orderBy(F.col("vec").isNull())
    first = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.select(*block, "_b", "_part", "id", F.first("_row").over(first).alias("gid"), F.first("vec").over(first).alias("vec"), F.row_number().over(same).alias("_at"))
    rows = rows.select(*block, "_b", "_part", "id", "gid", F.when(F.col("_at") % MEMBERS == 1, F.col("vec")).alias("vec"))
    path = scratch_path(spark, f"pair-vectors-{uuid.uuid4().hex}")
    # whole vectors go to Python here: fewer of them at a time
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(STEP))
    try:
        rows.write.partitionBy("_b", "_part").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(batch, before)
    return spark.read.schema(rows.schema).parquet(path)


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, block: list[str], threshold: float,
                  chunk: int = TILE) -> DataFrame:
    """All pairs (a < b) of one block with cosine >= threshold; output
    size is the answer size, candidate pairs stay inside the chunk product.

    Vectors travel as their nonzero components, equal ones once and with the ids that share them.  Those of a
    large block stay in files of about ``chunk`` rows in the shared folder: a task holds one of them and reads others, so
    what is written follows the rows, however many chunks meet.  Small blocks are shipped, a tile each."""
    rows = _dealt(df, id_col, vec_col, block, chunk)
    left, right = _tiles(rows.where("_b < 0"), block, chunk)
    key = [*block, "_i", "_j"]
    schema = "a_id long, b_id long, similarity double"
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_pairs_fn(threshold), schema)
    files = rows.where("_b >= 0").select("_b", "_part", F.col("_metadata.file_path").alias("_file")).distinct()
    others = files.select("_b", F.col("_file").alias("_other"), F.floor(F.col("_part") / RUN).alias("_run"))
    units = written(files.join(others, "_b").where(F.col("_file") <= F.col("_other")).groupBy("_file", "_run").agg(F.collect_list("_other").alias("_files")), "pair-units")
    if n := units.count():
        found = found.unionByName(units.repartition(n).mapInPandas(_file_pairs_fn(threshold), schema))
    return found


def exact_hash_hits(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Cheap first pass, equal prompt hash inside the block and live."""
    e = entries.select(*BLOCK, "e_id", "prompt_hash", "e_created_ms", "e_expires_ms")
    j = queries.join(e, list(BLOCK) + ["prompt_hash"], "inner").where(
        (F.col("e_created_ms") <= F.col("q_ts_ms")) & (F.col("q_ts_ms") < F.col("e_expires_ms")))
    return j.groupBy("q_id").agg(F.max_by("e_id", F.struct("e_created_ms", -F.col("e_id"))).alias("entry_id"))


def lsh_lookup(queries: DataFrame, entries: DataFrame, max_distance: float, bucket_length: float = 1.0,
               num_tables: int = 4, seed: int = 7) -> DataFrame:
    """Approximate lookup with Spark ML's bucketed random projection LSH.
    On unit vectors Euclidean distance d = sqrt(2 - 2 cos), so a cosine
    threshold t is the distance bound sqrt(2 - 2t).  Candidates come from
    equal hash buckets (an equi-join), then the exact block and TTL checks."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    qa = with_normalized(queries, "q_vec", "_unit").withColumn("features", array_to_vector("_unit")).drop("_unit")
    ea = with_normalized(entries, "e_vec", "_unit").withColumn("features", array_to_vector("_unit")).drop("_unit")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                        numHashTables=num_tables, seed=seed).fit(ea)
    pairs = model.approxSimilarityJoin(qa, ea, max_distance, distCol="dist")
    p = pairs.select(F.col("datasetA.q_id").alias("q_id"), F.col("datasetB.e_id").alias("entry_id"),
                     (1 - F.col("dist") * F.col("dist") / 2).alias("similarity"),
                     *[(F.col(f"datasetA.{c}") == F.col(f"datasetB.{c}")).alias(f"_same_{c}") for c in BLOCK],
                     F.col("datasetA.q_ts_ms").alias("q_ts_ms"), F.col("datasetB.e_created_ms").alias("c"),
                     F.col("datasetB.e_expires_ms").alias("x"), F.col("datasetB.e_id").alias("eid"))
    ok = p.where(F.col("_same_org_id") & F.col("_same_provider") & F.col("_same_model")
                 & (F.col("c") <= F.col("q_ts_ms")) & (F.col("q_ts_ms") < F.col("x")))
    return ok.groupBy("q_id").agg(F.max_by(F.struct("entry_id", "similarity"),
                                           F.struct("similarity", "c", -F.col("eid"))).alias("b")).select(
        "q_id", F.col("b.entry_id").alias("entry_id"), F.col("b.similarity").alias("similarity"))


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Hits and misses per (provider, model); skipped lookups count as
    neither."""
    return lookups.where(F.col("status") != "skipped").groupBy("provider", "model").agg(
        F.count_if(F.col("status") == "hit").alias("hits"), F.count_if(F.col("status") == "miss").alias("misses"))


def featurize(df: DataFrame, text_col: str, out: str = "features_vec", dim: int = 1024,
              min_doc_freq: int = 1) -> DataFrame:
    """A Spark-native text embedding for tables without supplied
    vectors: lower-cased letter/digit tokens, hashed term frequencies
    (``HashingTF``), ``IDF`` fitted on the corpus (one distributed
    aggregate) and L2 normalisation, returned as ``array<double>`` so the
    same cosine operators apply.  A model embedding, when available, is
    simply a column of the input instead."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    toks = df.withColumn("_toks", F.filter(F.split(F.lower(F.col(text_col)), "[^\\p{L}\\p{N}]+", -1),
                                            lambda s: s != ""))
    tf = HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=dim).transform(toks)
    idf = IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=min_doc_freq).fit(tf).transform(tf)
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0).transform(idf)
    return unit.withColumn(out, vector_to_array("_unit")).drop("_toks", "_tf", "_tfidf", "_unit")
