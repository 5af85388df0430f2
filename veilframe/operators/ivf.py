"""Similarity search over an inverted file of coarse cells.

The vectors of a block (org, provider, model) are dealt to the nearest of the block's
coarse centroids, fitted on a bounded sample; each cell knows its radius, the largest
angle between its centroid and a member.  Angles between unit vectors obey the
triangle inequality, so a query at angle ``a`` from a centroid is at least
``a - radius`` away from every member.  A cell where that exceeds the threshold's angle is
closed, and inside an open cell only members on the ring ``|a - angle| <= theta``
are scored.  Both bounds are exact; ``probes`` also limits the open cells to the nearest
ones, which is approximate.

Cells stand on shelves of about ``SHELF`` chunks of entries (a larger cell has its own, in parts).  Rows
meet on (block, shelf, part, slice): a query is copied once to every shelf with an
open cell of its own and carries the list of these cells, and the queries of a shelf come in slices of about
as many, so what a task holds grows neither with the block nor with its number of cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.cache import BLOCK, CHUNK, _chunked, _matrix
from veilframe.session import written

FINENESS = 2.0     # cells of a block, in square roots of its size: centroids and members cost alike
SAMPLE = 4_096     # vectors of a block that its centroids are fitted on, at most
ROUNDS = 6         # of fitting
SLACK = 1e-6       # radians, for rounding in the bounds
VISITORS = 512     # queries that meet the cells of their block at a time, at most
SHELF = 4          # chunks of entries, and of queries, that a meeting holds, about
STRIP_PAIRS = 1 << 20  # pairs scored at a time


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _none(names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _fit(block: list[str], fineness: float):
    """Spherical k-means over one block's sample."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h", kind="mergesort")
        m = _matrix(pdf, "vec")
        k = max(1, min(math.ceil(fineness * math.sqrt(int(pdf["_rows"].iloc[0]))), len(m) // 2))
        cents = m[:k].copy()
        for _ in range(ROUNDS):
            near = (m @ cents.T).argmax(axis=1)
            for c in range(k):
                total = m[near == c].sum(axis=0)
                size = np.linalg.norm(total)
                if size > 0:
                    cents[c] = total / size
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] * k for b in block}, "cell": np.arange(k, dtype="int32"), "centroid": list(cents)})
    return fn


def centroids(rows: DataFrame, block: list[str], id_col: str, vec_col: str, fineness: float = FINENESS, sample: int = SAMPLE) -> DataFrame:
    """(block, cell, centroid).  The sample is the ``sample`` smallest id hashes of a block, kept
    back per task before they meet; every vector is indexed."""
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"))
    hashed = rows.select(*block, F.col(vec_col).cast("array<double>").alias("vec"), F.xxhash64(id_col).alias("_h"))
    picked = hashed.withColumn("_nth", F.row_number().over(Window.partitionBy(*block).orderBy("_h"))).where(F.col("_nth") <= sample).drop("_nth")
    return picked.join(sizes, block).groupBy(*block).applyInPandas(_fit(block, fineness), f"{_types(rows, block)}, cell int, centroid array<double>")


def _met_with_cells(rows: DataFrame, cells: DataFrame, block: list[str], id_col: str, chunk: int, fn, schema: str) -> DataFrame:
    """``fn(rows, cells)`` for every chunk of a block's rows with all of the block's cells."""
    chunks = _chunked(rows, block, id_col, "r", chunk)
    copies = cells.join(chunks.select(*block, "_n_r").distinct(), block).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_n_r") - 1)))
    key = [*block, "_chunk"]
    return chunks.drop("_n_r").groupBy(*key).cogroup(copies.drop("_n_r").groupBy(*key)).applyInPandas(fn, schema)


def build(entries: DataFrame, block: list[str], id_col: str, vec_col: str, fineness: float = FINENESS,
          chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The inverted file (index, cells): every entry with its ``cell`` and its ``angle`` to the
    centroid, written; and the cells with centroid, radius and number of parts."""
    def assign(rows, cents):
        if len(rows) == 0:
            return _none(names)
        angles = _angles(_matrix(rows, vec_col), np.stack(cents["centroid"].to_numpy()))
        at = angles.argmin(axis=1)
        out = rows.drop(columns="_chunk")
        out["cell"], out["angle"] = cents["cell"].to_numpy()[at].astype("int32"), angles[np.arange(len(at)), at]
        return out[names]

    names = [*entries.columns, "cell", "angle"]
    cents = written(centroids(entries, block, id_col, vec_col, fineness), "ivf-centroids")
    index = written(_met_with_cells(entries, cents, block, id_col, chunk, assign, f"{_types(entries, entries.columns)}, cell int, angle double"), "ivf-index")
    shape = index.groupBy(*block, "cell").agg(F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / (SHELF * chunk)).cast("int").alias("parts"), F.count(F.lit(1)).alias("_size"))
    return index, cents.join(shape, [*block, "cell"])


def _shelved(cells: DataFrame, block: list[str], shelf: int) -> DataFrame:
    """Cells with the ``shelf`` they stand on: neighbours by number, about ``shelf`` entries together (a
    larger cell has shelves of its own, one per part)."""
    before = F.sum("_size").over(Window.partitionBy(*block).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    small = F.col("_size") <= shelf
    # shelves of small cells are numbered 0, 1, ..., those of a large cell -1 - cell
    return (cells.withColumn("_size", F.least("_size", F.lit(shelf + 1))).withColumn("_before", F.coalesce(before, F.lit(0)))
                 .withColumn("shelf", F.when(small, F.floor(F.col("_before") / shelf)).otherwise(-1 - F.col("cell")).cast("long")).drop("_before", "_size"))


def _visits(rows: DataFrame, cells: DataFrame, block: list[str], id_col: str, vec_col: str, probes: int | None, chunk: int) -> DataFrame:
    """Each row once per shelf on which its bound leaves a cell open (at most the ``probes`` nearest
    cells), with its ``theta`` (the threshold's angle), these cells and its angles to them.

    A chunk of rows meets all cells of the block, so it is the smaller the more cells there are."""
    def visit(qs, cs):
        if len(qs) == 0 or len(cs) == 0:
            return _none(names)
        cs = cs.sort_values(["shelf", "cell"], kind="mergesort")
        angles = _angles(_matrix(qs, vec_col), np.stack(cs["centroid"].to_numpy()))
        theta = np.arccos(np.clip(qs["threshold"].to_numpy(np.float64), -1, 1))
        is_open = angles - cs["radius"].to_numpy()[None, :] <= theta[:, None] + SLACK
        if probes is not None and len(cs) > probes:
            rank = np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1, kind="stable")
            is_open &= rank < probes
        shelves, number, parts = cs["shelf"].to_numpy(), cs["cell"].to_numpy().astype("int32"), cs["parts"].to_numpy()
        starts = np.flatnonzero(np.r_[True, shelves[1:] != shelves[:-1]])
        out = []
        for lo, hi in zip(starts, [*starts[1:], len(shelves)], strict=True):
            i = np.flatnonzero(is_open[:, lo:hi].any(axis=1))
            some = [np.flatnonzero(is_open[k, lo:hi]) + lo for k in i]
            part = qs.drop(columns="_chunk").iloc[i].reset_index(drop=True)
            part["shelf"], part["parts"], part["theta"] = shelves[lo], parts[lo:hi].max(), theta[i]
            part["cells"], part["angles"] = pd.Series([number[c] for c in some], dtype=object), pd.Series([angles[k, c] for k, c in zip(i, some, strict=True)], dtype=object)
            out.append(part)
        return pd.concat(out)[names]

    names = [*rows.columns, "shelf", "parts", "theta", "cells", "angles"]
    met = _met_with_cells(rows, cells, block, id_col, min(chunk, VISITORS), visit,
                          f"{_types(rows, rows.columns)}, shelf long, parts int, theta double, cells array<int>, angles array<double>")
    return met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _meetings(rows: DataFrame, index: DataFrame, cells: DataFrame, block: list[str], id_col: str, entry_id: str, vec_col: str, probes: int | None, chunk: int,
              fn, schema: str) -> DataFrame:
    """``fn(queries, entries)`` for the open cells of every (shelf, part) with every slice of about
    ``SHELF`` chunks of the queries that visit it: both sides of a meeting are bounded, and a vector is
    copied once per shelf or slice and not once per cell."""
    shelved = _shelved(cells, block, SHELF * chunk)
    visits = written(_visits(rows, shelved, block, id_col, vec_col, probes, chunk), "ivf-visits")
    place = [*block, "shelf", "part"]
    slices = visits.groupBy(*place).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (SHELF * chunk))).cast("int").alias("_slices"))
    entries = index.join(shelved.select(*block, "cell", "shelf", "parts"), [*block, "cell"]).withColumn(
        "part", F.pmod(F.xxhash64(entry_id), F.col("parts")).cast("int")).drop("parts")
    asked = visits.join(slices, place).withColumn("_slice", F.pmod(F.xxhash64(id_col), F.col("_slices")).cast("int")).drop("_slices")
    held = entries.join(slices, place).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    key = [*place, "_slice"]
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(fn, schema)


def _by_cell(qp: pd.DataFrame, ep: pd.DataFrame, q_vec: str, e_vec: str):
    """(queries, entries, similarity, ring) of a meeting, cell by cell in strips: places of the queries that
    have the cell open, of its entries, and which pairs the ring bound leaves."""
    qm, em = _matrix(qp, q_vec), _matrix(ep, e_vec)
    opened = np.concatenate([np.asarray(c) for c in qp["cells"]])
    who = np.repeat(np.arange(len(qp)), [len(c) for c in qp["cells"]])
    angle = np.concatenate([np.asarray(a) for a in qp["angles"]])
    theta, off, number = qp["theta"].to_numpy(), ep["angle"].to_numpy(), ep["cell"].to_numpy()
    by_query, by_entry = np.argsort(opened, kind="stable"), np.argsort(number, kind="stable")
    opened, number = opened[by_query], number[by_entry]
    for c in np.unique(number):
        members = by_entry[np.searchsorted(number, c):np.searchsorted(number, c, side="right")]
        asking = by_query[np.searchsorted(opened, c):np.searchsorted(opened, c, side="right")]
        strip = max(1, STRIP_PAIRS // len(members))
        for lo in range(0, len(asking), strip):
            some = asking[lo:lo + strip]
            q = who[some]
            ring = np.abs(angle[some][:, None] - off[members][None, :]) <= theta[q][:, None] + SLACK
            yield q, members, qm[q] @ em[members].T, ring


def _best_in_shelf(qp: pd.DataFrame, ep: pd.DataFrame) -> pd.DataFrame:
    """Of each query the best live entry on its rings (similarity, newest, smallest id), with
    how many entries were scored."""
    if len(qp) == 0 or len(ep) == 0:
        return _none(["q_id", "entry_id", "similarity", "entry_created_ms", "scored"])
    # newest first, then the smallest id: argmax takes the first of equals
    ep = ep.sort_values(["e_created_ms", "e_id"], ascending=[False, True], kind="mergesort")
    made, gone, ids = (ep[c].to_numpy() for c in ("e_created_ms", "e_expires_ms", "e_id"))
    asked, floor = qp["q_ts_ms"].to_numpy(), qp["threshold"].to_numpy()
    best, at, scored = np.full(len(qp), -np.inf), np.zeros(len(qp), dtype=np.int64), np.zeros(len(qp), dtype=np.int64)
    for q, members, sim, ring in _by_cell(qp, ep, "q_vec", "e_vec"):
        scored[q] += ring.sum(axis=1)
        ok = ring & (made[members][None, :] <= asked[q][:, None]) & (asked[q][:, None] < gone[members][None, :]) & (sim >= floor[q][:, None])
        sim = np.where(ok, sim, -np.inf)
        pick = sim.argmax(axis=1)
        top, place = sim[np.arange(len(q)), pick], members[pick]
        better = (top > best[q]) | ((top == best[q]) & np.isfinite(top) & (place < at[q]))
        best[q[better]], at[q[better]] = top[better], place[better]
    some = np.isfinite(best)
    pick = lambda values: pd.Series(values, dtype="Int64").where(some)
    return pd.DataFrame({"q_id": qp["q_id"].to_numpy(), "entry_id": pick(ids[at]), "similarity": pd.Series(best).where(some),
                         "entry_created_ms": pick(made[at]), "scored": scored})


def lookup(queries: DataFrame, entries: DataFrame, probes: int | None = None, fineness: float = FINENESS, chunk: int = CHUNK) -> DataFrame:
    """Each query's nearest live entry of its own block that reaches its threshold.

    ``queries`` and ``entries`` as in ``cache.cache_lookup``.  Without ``probes`` the answer is exact
    (cells are closed by the bound only); with it a query visits its ``probes`` nearest
    cells.  Returns (q_id, entry_id, similarity, scored) for queries that visited a cell: entry_id
    is null on a miss, ``scored`` counts the entries that were compared with the query."""
    block = list(BLOCK)
    index, cells = build(entries.select(*block, "e_id", "e_vec", "e_created_ms", "e_expires_ms"), block, "e_id", "e_vec", fineness, chunk)
    asked = queries.select(*block, "q_id", "q_vec", "q_ts_ms", F.col("threshold").cast("double").alias("threshold"))
    best = _meetings(asked, index, cells, block, "q_id", "e_id", "q_vec", probes, chunk, _best_in_shelf,
                     "q_id long, entry_id long, similarity double, entry_created_ms long, scored long")
    hit = F.when(F.col("entry_id").isNotNull(), F.struct("similarity", F.col("entry_created_ms").alias("made"), (-F.col("entry_id")).alias("neg")))
    top = best.groupBy("q_id").agg(F.max(hit).alias("b"), F.sum("scored").alias("scored"))
    return top.select("q_id", (-F.col("b.neg")).alias("entry_id"), F.col("b.similarity").alias("similarity"), "scored")


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, block: list[str], threshold: float, fineness: float = FINENESS, chunk: int = CHUNK) -> DataFrame:
    """D9, exact: pairs (a < b) of one block with cosine >= ``threshold``, found through the cells.

    Equal vectors are searched once: ``a_id`` is linked to the smallest id of each group of
    equal vectors, and every other member of a group to its smallest (``copies``), so a group of n
    copies gives n - 1 links instead of all its pairs.  Returns (a_id, b_id, similarity, copies)."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(*block, F.col(id_col).alias("id"), vec.alias("vec"))
    groups = written(rows.groupBy(*block, "vec").agg(F.min("id").alias("id")), "ivf-distinct")
    copies = rows.join(groups.select(*block, "vec", F.col("id").alias("first")), [*block, "vec"]).where("id <> first").select(
        F.col("first").alias("a_id"), F.col("id").alias("b_id"), F.lit(1.0).alias("similarity"), F.lit(True).alias("copies"))
    index, cells = build(groups, block, "id", "vec", fineness, chunk)
    asked = groups.select(*block, F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), F.lit(float(threshold)).alias("threshold"))

    def pairs(qp, ep):
        found = []
        if len(qp) and len(ep):
            a, b = qp["q_id"].to_numpy(), ep["id"].to_numpy()
            for q, members, sim, ring in _by_cell(qp, ep, "q_vec", "vec"):
                i, j = np.nonzero(ring & (sim >= threshold) & (a[q][:, None] < b[members][None, :]))
                if len(i):
                    found.append(pd.DataFrame({"a_id": a[q[i]], "b_id": b[members[j]], "similarity": sim[i, j]}))
        return pd.concat(found) if found else _none(["a_id", "b_id", "similarity"])

    kind = df.schema[id_col].dataType.simpleString()
    found = _meetings(asked, index, cells, block, "q_id", "id", "q_vec", None, chunk, pairs, f"a_id {kind}, b_id {kind}, similarity double")
    return found.withColumn("copies", F.lit(False)).unionByName(copies)
