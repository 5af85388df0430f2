"""Ranked lexical search by norm buckets: long impact vectors first, Cauchy-Schwarz closes buckets,
coordinate bounds filter inside them, survivors are scored in integers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import documents, running_starts, stored
from veilframe.sources.tables import load

# letters A-Z fold, every other ASCII character that is no letter or digit parts terms
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))
BLOCK = 100_000     # distinct (item, term) pairs that are searched at once
FOCUS = 8           # coordinates of an item that the bound inside a bucket reads
BUCKET = 4_096      # vectors in a bucket
SEEDS = 0.02        # share of the longest vectors that give the first thresholds
SLACK = 1 + 1e-9    # for rounding in the bounds, which are doubles


def terms(text: str | None) -> list[bytes]:
    """All terms of a text, with repeats, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def _item_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(r, i, t, n) for r, i, text in zip(frame["row"], frame["item_id"], frame["text"], strict=True) for t, n in Counter(terms(text)).items()]
        yield pd.DataFrame(rows, columns=["row", "item_id", "term", "times"]).astype({"row": "int64", "times": "int64"})


def _counter(vocabulary: dict[bytes, int]):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, ns, ts, fs = [], [], [], []
            for i, text in zip(frame["doc_id"], frame["text"], strict=True):
                words = terms(text)
                if words:
                    hits = sorted((vocabulary[w], n) for w, n in Counter(words).items() if w in vocabulary)
                    ids.append(i)
                    ns.append(len(words))
                    ts.append([t for t, _ in hits])
                    fs.append([f for _, f in hits])
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=frame["doc_id"].dtype), "n": pd.Series(ns, dtype="int64"), "terms": ts, "times": fs})
    return count


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated values and the start of each list."""
    sizes = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if sizes.sum() else np.zeros(0, np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([values[:0], [0], np.cumsum(values)])[starts])


def _impacts(n_docs: int, n_terms: int, weights: np.ndarray):
    """Impact vectors: per matching term (10^9 tf) div (1000 tf + 12 m); the length is
    taken with each term scaled by the root of its weight."""
    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            flat, starts = _flat(list(frame["terms"]))
            tf, _ = _flat(list(frame["times"]))
            m = np.array([75 + (25 * int(n) * n_docs) // n_terms for n in frame["n"]], dtype=np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(starts)))
            norm = np.sqrt(_row_sums(impact.astype(np.float64) ** 2 * weights[flat], starts).clip(0))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "norm": norm, "terms": frame["terms"],
                                "impacts": [impact[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]})
    return measure


class Items:
    """A block of items as sparse vectors: per item its rows' (term, repeats), scaled coordinates in
    descending order and length."""

    def __init__(self, rows: list[tuple[int, int, int]], weights: np.ndarray, root: np.ndarray):
        self.weights, self.root = weights, root
        by: dict[int, list[tuple[int, int]]] = {}
        for row, term, times in rows:
            if weights[term] > 0:
                by.setdefault(row, []).append((term, times))
        self.vectors = []
        for row, pairs in sorted(by.items()):
            t = np.array([p[0] for p in pairs], dtype=np.int64)
            r = np.array([p[1] for p in pairs], dtype=np.int64)
            q = r * root[t]
            order = np.argsort(-q, kind="stable")
            t, r, q = t[order], r[order], q[order]
            rest = math.sqrt(float((q[FOCUS:] ** 2).sum()))
            self.vectors.append((row, t, r, q, math.sqrt(float((q ** 2).sum())), rest))


def _search(items: Items, k: int, floors: dict[int, int]):
    """Best ``k`` vectors of each item among a task's vectors, which come longest first.

    ``floors`` are scores that ``k`` vectors are known to reach. An item's threshold is the
    larger of its floor and its k-th best score in this task; it only rises. A bucket whose
    longest vector cannot reach it is closed, and so is every later one.
    """
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple]] = {}
        edge = {v[0]: max(1, floors.get(v[0], 1)) for v in items.vectors}
        scores = np.zeros(len(items.weights), dtype=np.int64)
        for frame in frames:
            for at in range(0, len(frame), BUCKET):
                _bucket(frame.iloc[at:at + BUCKET], items, k, best, edge, scores)
        rows = [(row, int(s), doc) for row, found in best.items() for s, _, doc in found]
        yield pd.DataFrame({"row": pd.Series([r[0] for r in rows], dtype="int64"), "score": pd.Series([r[1] for r in rows], dtype="int64"),
                            "doc_id": pd.Series([r[2] for r in rows], dtype="object")})
    return search


def _bucket(frame: pd.DataFrame, items: Items, k: int, best: dict, edge: dict, scores: np.ndarray) -> None:
    norm = frame["norm"].to_numpy()
    longest = float(norm.max())
    live = [v for v in items.vectors if v[4] * longest * SLACK >= edge[v[0]]]
    if not live:
        return
    flat, starts = _flat(list(frame["terms"]))
    impact, _ = _flat(list(frame["impacts"]))
    owner = np.repeat(np.arange(len(frame)), np.diff(starts))
    # postings of the bucket: where each term's entries lie
    order = np.argsort(flat, kind="stable")
    doc_of, value = owner[order], impact[order] * items.root[flat[order]]
    heads = np.searchsorted(flat[order], np.arange(len(items.weights) + 1))
    ids = frame["doc_id"].to_numpy()
    known = pd.isna(frame["doc_id"]).to_numpy()
    for row, t, r, q, length, rest in live:
        part, square = np.zeros(len(frame)), np.zeros(len(frame))
        for f, weight in zip(t[:FOCUS], q[:FOCUS], strict=True):
            where, x = doc_of[heads[f]:heads[f + 1]], value[heads[f]:heads[f + 1]]
            part[where] += weight * x
            square[where] += x * x
        bound = np.minimum(length * norm, part + rest * np.sqrt((norm * norm * SLACK - square).clip(0)))
        left = np.flatnonzero(bound * SLACK >= edge[row])
        if not len(left):
            continue
        scores[t] = r * items.weights[t]
        sizes = starts[left + 1] - starts[left]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts[left] - (ends - sizes), sizes)
        exact = _row_sums(scores[flat[at]] * impact[at], np.concatenate([[0], ends]))
        scores[t] = 0
        hit = np.flatnonzero(exact >= edge[row])
        found = best.get(row, []) + [(int(exact[h]), bool(known[left[h]]), None if known[left[h]] else ids[left[h]]) for h in hit]
        # highest score first, then smaller ids, rows without an id last
        found.sort(key=lambda e: (-e[0], e[1], 0 if e[1] else e[2]))
        best[row] = found[:k]
        if len(best[row]) == k:
            edge[row] = max(edge[row], best[row][-1][0])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score.

    Items are searched in blocks of at most ``block`` distinct (item, term) pairs (one item
    more than that makes a block of its own), which bounds what the driver sends to the tasks. For a
    block, the documents' matching terms are counted and stored; impact vectors are ordered
    by length into tasks and buckets; the longest ones give each item a first threshold, and
    with it all vectors that may still reach one of the thresholds are searched.

    A row is a document of its own, also when its id repeats; equal scores rank by ascending
    id, null ids last. Null and empty texts hold no term: such a document counts for nothing and
    such an item gets no row. Items that repeat an id are searched apart. Empty tables give an
    empty result. Only the named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    asked = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    pairs = stored(asked.mapInPandas(_item_terms, f"row long, item_id {item_kind}, term binary, times long"), "search-items")
    sizes = pairs.groupBy("row").agg(F.count(F.lit(1)).alias("size"))
    placed = stored(running_starts(sizes, "row", "size", "before", name="search-blocks").withColumn("block", F.floor(F.col("before") / block)), "search-placed")
    n_blocks = (placed.agg(F.max("block")).first()[0] or 0) + 1
    parts = []
    for b in range(n_blocks):
        mine = pairs.join(placed.where(F.col("block") == b).select(F.col("row").alias("mine")), F.col("row") == F.col("mine"), "left_semi")
        parts.append(_search_block(rows, mine, k, kind))
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = pairs.groupBy("row").agg(F.first("item_id").alias("item_id"))
    return top.join(names, "row").select("item_id", "rank", "doc_id", "score")


def _search_block(rows: DataFrame, mine: DataFrame, k: int, kind: str) -> DataFrame:
    """Hits (row, score, doc_id) of one block of items: every task's best, so a superset of the best."""
    asked = [(r["row"], bytes(r["term"]), r["times"]) for r in mine.select("row", "term", "times").collect()]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, t, _ in asked}))}
    counted = stored(rows.mapInPandas(_counter(vocabulary), f"doc_id {kind}, n long, terms array<int>, times array<int>"), "search-counts")
    totals = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, n_terms = totals[0], totals[1] or 1
    df = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    found = Items([(row, vocabulary[t], times) for row, t, times in asked], weights, np.sqrt(weights.astype(np.float64)))
    vectors = counted.where(F.size("terms") > 0).mapInPandas(
        _impacts(n_docs, n_terms, weights.astype(np.float64)), f"doc_id {kind}, norm double, terms array<int>, impacts array<int>")
    # longest first over tasks and inside them; equal lengths spread by row
    ordered = vectors.where("norm > 0").withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(F.desc("norm"), "nth").sortWithinPartitions(F.desc("norm"))
    kept = stored(ordered.drop("nth"), "search-vectors")
    shape = f"row long, score long, doc_id {kind}"
    least = kept.agg(F.percentile_approx("norm", F.lit(1 - SEEDS), F.lit(1000))).first()[0]
    if least is None:
        return kept.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("score"), "doc_id").where("false")
    first = kept.where(F.col("norm") >= least).mapInPandas(_search(found, k, {}), shape)
    order = Window.partitionBy("row").orderBy(F.desc("score"))
    floors = {r["row"]: r["score"] for r in first.withColumn("at", F.row_number().over(order)).where(F.col("at") == k).collect()}
    # no item can use a vector shorter than this
    reach = min((max(1, floors.get(v[0], 1)) / (v[4] * SLACK) for v in found.vectors), default=math.inf)
    return stored(kept.where(F.col("norm") * SLACK >= F.lit(float(reach))).mapInPandas(_search(found, k, floors), shape), "search-hits")


def op12_ranked_search(spark, sf_dir) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d WHERE len(ts) > 0),
g AS (SELECT count(DISTINCT r) AS big_n, count(*) AS big_l FROM t),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term, big_n),
b AS (SELECT row_number() OVER () AS q, item_id,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
      FROM b JOIN f USING (term) JOIN w USING (term), g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 20
"""
