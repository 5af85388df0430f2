"""Sliding-window admission against hand-worked cases and a brute-force
replay (the reference ships no rate-limit tests)."""

import random
from collections import deque

from veilframe.operators import ratelimit as R


def _admit(spark, rows, limit, window):
    df = spark.createDataFrame(rows, "k string, t long, id long")
    out = R.admit(df, "k", "t", "id", limit, window).collect()
    return {r["id"]: (r["admitted"], r["current"], r["retry_after_ms"]) for r in out}


def _brute(rows, limit, window):
    res = {}
    by_key = {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        q = by_key.setdefault(k, deque())
        while q and q[0] <= t - window:
            q.popleft()
        if len(q) >= limit:
            res[i] = (False, len(q), window - (t - q[0]))
        else:
            q.append(t)
            res[i] = (True, len(q), 0)
    return res


def test_hand_worked_sequence(spark):
    rows = [("k", 0, 1), ("k", 100, 2), ("k", 200, 3), ("k", 1000, 4), ("k", 1100, 5), ("k", 2500, 6)]
    got = _admit(spark, rows, 2, 1000)
    assert got == {1: (True, 1, 0), 2: (True, 2, 0), 3: (False, 2, 800), 4: (True, 2, 0),
                   5: (True, 2, 0), 6: (True, 1, 0)}


def test_matches_brute_force_with_hot_key_and_ties(spark):
    rnd = random.Random(7)
    rows, i = [], 0
    for key, n, spread in (("hot", 600, 20_000), ("mid", 120, 60_000), ("cold", 30, 400_000)):
        for _ in range(n):
            i += 1
            rows.append((key, rnd.randrange(spread) // 10 * 10, i))  # many equal timestamps
    got = _admit(spark, rows, 3, 1000)
    assert got == _brute(rows, 3, 1000)


def test_per_key_limit_column(spark):
    rnd = random.Random(11)
    limits = {"a": 1, "b": 2, "c": 5}
    rows, i = [], 0
    for key in limits:
        for _ in range(150):
            i += 1
            rows.append((key, rnd.randrange(30_000), i))
    df = spark.createDataFrame([(k, t, j, limits[k]) for k, t, j in rows], "k string, t long, id long, lim int")
    out = {r["id"]: (r["admitted"], r["current"], r["retry_after_ms"])
           for r in R.admit(df, "k", "t", "id", "lim", 1000).collect()}
    expected = {}
    for key, lim in limits.items():
        expected.update(_brute([r for r in rows if r[0] == key], lim, 1000))
    assert out == expected


def test_zero_limit_and_null_key(spark):
    rows = [(None, 0, 1), (None, 0, 2), ("a", 5, 3), (None, 500, 4), (None, 1000, 5)]
    assert _admit(spark, rows, 0, 1000) == {i: (False, 0, 0) for i in (1, 2, 3, 4, 5)}
    assert _admit(spark, rows, 1, 1000) == {1: (True, 1, 0), 2: (False, 1, 1000), 3: (True, 1, 0), 4: (False, 1, 500), 5: (True, 1, 0)}


def test_limit_that_changes_over_time(spark):
    rnd = random.Random(5)
    rows = sorted(("k", t, i, 4 if (t // 3000) % 2 else 1) for i, t in enumerate(rnd.randrange(20_000) for _ in range(400)))
    df = spark.createDataFrame(rows, "k string, t long, id long, lim int")
    got = {r["id"]: (r["admitted"], r["current"], r["retry_after_ms"]) for r in R.admit(df, "k", "t", "id", "lim", 1000).collect()}
    live, want = deque(), {}
    for _, t, i, lim in sorted(rows, key=lambda r: (r[1], r[2])):
        while live and live[0] <= t - 1000:
            live.popleft()
        if len(live) >= lim:
            want[i] = (False, len(live), 1000 - (t - live[0]))
        else:
            live.append(t)
            want[i] = (True, len(live), 0)
    assert got == want


def test_no_frame_slides(spark):
    """Loads are running sums: a sliding frame is summed anew for every row, so a bucket's work
    would grow with the square of its rows.  The sums equal a brute-force count, ties included."""
    rows = [(i, k, t) for i, (k, t) in enumerate([("a", x) for x in (0, 0, 5, 999, 1000, 1000, 1005, 1999, 2000, 2600, 7000)] + [("b", -3), ("b", 996), ("b", 997), (None, 4), (None, 1003)])]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    rate, admitted = R.offered_rate(df, "k", "t", 1000), R.admit(df, "k", "t", "id", 2, 1000)
    assert {r["id"]: r["offered"] for r in rate.collect()} == {i: sum(1 for _, j, s in rows if j == k and t - 1000 < s <= t) for i, k, t in rows}
    for d in (rate, admitted):
        plan = d._jdf.queryExecution().executedPlan().toString().lower()
        assert "rangeframe, unboundedpreceding" in plan and "rangeframe, -" not in plan


def test_rows_without_a_time_keep_their_load(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", 7)], "id long, k string, t long")
    assert {r["id"]: r["offered"] for r in R.offered_rate(df, "k", "t", 1000).collect()} == {1: 4, 2: 4, 3: 1}
