"""The blocked similarity join against brute force, and what it ships."""

import numpy as np

from veilframe.operators import cache as C


def test_pairs_of_rows_by_one_triangle_of_packed_tiles(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(40, 6)) * (rnd.random((40, 6)) < 0.7)
    vs = [[float(x) for x in base[rnd.integers(40)] * rnd.choice([1.0, 2.0])] for _ in range(150)] + [[0.0] * 6, [0.0] * 6]
    rows = [(i % 140, ("x", "y", None)[i % 3], v) for i, v in enumerate(vs)] + [(500, "x", None), (None, "x", vs[0]), (501, "x", [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    unit = [(i, lab, np.array(v) / (np.linalg.norm(v) or 1)) for i, lab, v in rows if i is not None and v is not None and lab is not None]
    want = sorted((i, j) for i, a, u in unit for j, b, w in unit if a == b and i < j and u @ w >= 0.8)
    for chunk in (7, 1000):
        got = C.similar_pairs(df, "id", "vec", ["label"], 0.8, chunk=chunk).collect()
        assert sorted((r["a_id"], r["b_id"]) for r in got) == want and want
    # a vector meets every chunk of its block once (its own twice), without its zeros
    packed = spark.createDataFrame([(g, "x", b"") for g in range(60)], "gid long, label string, vec binary")
    left, right = C._tiles(packed, ["label"], 10)
    assert left.count() + right.count() == 60 * 7 and left.where("_i > _j").count() == right.where("_i > _j").count() == 0
    plan = C.similar_pairs(df, "id", "vec", ["label"], 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "array" not in plan.lower()


def test_vectors_of_a_large_block_stay_in_their_files(spark, monkeypatch):
    """Only small blocks are shipped; chunks of a large one meet where they lie, also copies split over several
    holders of their vector, ids that repeat, and vectors longer than the components that rule pairs out."""
    rnd = np.random.default_rng(11)
    base = np.where(rnd.random((25, 700)) < 0.2, rnd.random((25, 700)), 0.0)
    vs = []
    for i in range(160):
        v = base[rnd.integers(25) if i % 4 else 3].copy()
        if i % 3 == 0:
            v[rnd.integers(700, size=rnd.integers(1, 30))] += 0.5
        vs.append(v)
    vs[7], vs[8] = np.zeros(700), vs[9][:650]
    rows = [(i % 150, "x" if i < 140 else f"small{i % 2}", [float(c) for c in v]) for i, v in enumerate(vs)]
    wide = lambda v: np.pad(v / (np.linalg.norm(v) or 1), (0, 700 - len(v)))
    unit = [(i, lab, wide(v)) for (i, lab, _), v in zip(rows, vs, strict=True)]
    want = sorted((min(i, j), max(i, j), round(float(u @ w), 6)) for k, (i, a, u) in enumerate(unit) for j, b, w in unit[:k] if a == b and i != j and u @ w >= 0.8)
    shipped, tiles = [], C._tiles
    monkeypatch.setattr(C, "MEMBERS", 4, raising=False)
    monkeypatch.setattr(C, "_tiles", lambda *given: [shipped.append(side) or side for side in tiles(*given)])
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    got = C.similar_pairs(df, "id", "vec", ["label"], 0.8, chunk=100).collect()
    assert sorted((r["a_id"], r["b_id"], round(r["similarity"], 6)) for r in got) == want and want
    assert [side.count() for side in shipped] == [20, 20] and all(side.where("label = 'x'").count() == 0 for side in shipped)
