"""The inverted file: exact answers by bounds alone, recall and pairs scored when probing."""

import random

import numpy as np
from pyspark.sql import functions as F

from veilframe.operators import cache as C
from veilframe.operators import ivf
from veilframe.plans import cache_queries as CQ


def vectors(n, seed, dim=8, centers=6):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(centers, dim))
    return [(base[rnd.integers(centers)] + rnd.normal(scale=0.3, size=dim)).tolist() for _ in range(n)]


def unit(v):
    return np.array(v) / np.linalg.norm(v)


def tables(spark):
    rnd = random.Random(3)
    e = [(i, i % 2, "p", "m", v, rnd.randrange(100), rnd.randrange(100, 200)) for i, v in enumerate(vectors(240, 1))]
    e += [(500 + i, *r[1:5], r[5], r[6]) for i, r in enumerate(e[:20])]  # equal vectors: ties
    q = [(i, i % 3, "p", "m", v, rnd.randrange(220), rnd.choice([0.5, 0.9, 0.99])) for i, v in enumerate(vectors(90, 1) + [r[4] for r in e[:30]])]
    return (q, e, spark.createDataFrame(q, "q_id long, org_id int, provider string, model string, q_vec array<double>, q_ts_ms long, threshold double"),
            spark.createDataFrame(e, "e_id long, org_id int, provider string, model string, e_vec array<double>, e_created_ms long, e_expires_ms long"))


def brute(q, e):
    out = {}
    for qid, org, _, _, v, ts, t in q:
        hits = [(round(float(unit(v) @ unit(w)), 9), made, -eid) for eid, o, _, _, w, made, gone in e
                if o == org and made <= ts < gone and unit(v) @ unit(w) >= t]
        if hits:
            out[qid] = -max(hits)[2]
    return out


def test_bounds_alone_give_the_exact_answer(spark):
    q, e, dq, de = tables(spark)
    want = brute(q, e)
    for chunk, fineness in ((2048, 2.0), (7, 3.0)):
        rows = ivf.lookup(dq, de, chunk=chunk, fineness=fineness).collect()
        assert {r["q_id"]: r["entry_id"] for r in rows if r["entry_id"] is not None} == want
    assert want and len(want) < len(q)
    assert ivf.lookup(dq, de.where("e_id < 0")).count() == 0 and ivf.lookup(dq.where("q_id < 0"), de).count() == 0


def test_closed_cells_are_not_scored(spark):
    """On clustered vectors the bounds close most of a block for a high threshold."""
    _, e, _, de = tables(spark)
    dq = de.where("org_id = 0").select(F.col("e_id").alias("q_id"), "org_id", "provider", "model", F.col("e_vec").alias("q_vec"), F.lit(150).cast("long").alias("q_ts_ms"),
                                       F.lit(0.99).alias("threshold"))
    scored = ivf.lookup(dq, de, fineness=4.0).agg(F.sum("scored")).first()[0]
    n = sum(1 for r in e if r[1] == 0)
    assert scored < 0.25 * n * n


def test_probing_recall_and_share_of_pairs(spark):
    sf = "/root/testdata/sf0.1"
    q, e = C.cacheable(CQ.cache_queries(spark, sf)), CQ.cache_entries(spark, sf)
    exact = {r["query_id"]: r["entry_id"] for r in C.nearest_entries(q.select("q_id", *C.BLOCK, "q_vec", "q_ts_ms", "threshold"), e).collect()}
    rows = ivf.lookup(q, e, probes=1).collect()
    got = {r["q_id"]: r["entry_id"] for r in rows}
    b = list(C.BLOCK)
    pairs = q.groupBy(*b).count().join(e.groupBy(*b).agg(F.count("*").alias("n")), b).agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert sum(got.get(k) == v for k, v in exact.items()) >= 0.9 * len(exact)
    assert sum(r["scored"] for r in rows) < 0.05 * pairs


def test_pairs_are_whole_and_copies_linked_once(spark):
    vs = vectors(120, 5)
    rows = [(i, i % 2, v) for i, v in enumerate(vs)] + [(1000 + i, 0, vs[0]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    got = ivf.similar_pairs(df, "id", "vec", ["label"], 0.95, chunk=9).collect()
    first = [(i, lab, v) for i, lab, v in rows if i < 1000]
    want = {(a, b) for a, la, u in first for b, lb, w in first if la == lb and a < b and unit(u) @ unit(w) >= 0.95}
    assert {(r["a_id"], r["b_id"]) for r in got if not r["copies"]} == want and want
    assert {(r["a_id"], r["b_id"]) for r in got if r["copies"]} == {(0, 1000 + i) for i in range(50)}
    assert len(got) == len(want) + 50


def test_meetings_are_bounded_on_both_sides(spark, monkeypatch):
    """However many queries share a cell and however large it is, a task holds about ``SHELF`` chunks of
    each side, and a query is copied per shelf and not per open cell."""
    q, e, dq, de = tables(spark)
    block = list(C.BLOCK)
    asked = dq.select(*block, "q_id", "q_vec", "q_ts_ms", "threshold")
    for chunk, fineness in ((5, 3.0), (11, 0.01)):  # 0.01: one cell a block, in parts
        index, cells = ivf.build(de.select(*block, "e_id", "e_vec", "e_created_ms", "e_expires_ms"), block, "e_id", "e_vec", fineness, chunk)
        sizes = ivf._meetings(asked, index, cells, block, "q_id", "e_id", "q_vec", None, chunk,
                              lambda qp, ep: __import__("pandas").DataFrame({"q": [len(qp)], "e": [len(ep)]}), "q long, e long").collect()
        assert max(r["q"] for r in sizes) <= 2 * ivf.SHELF * chunk and max(r["e"] for r in sizes) <= 2 * ivf.SHELF * chunk
        assert len(sizes) > 1 and {r["q_id"]: r["entry_id"] for r in ivf.lookup(dq, de, chunk=chunk, fineness=fineness).where("entry_id is not null").collect()} == brute(q, e)
