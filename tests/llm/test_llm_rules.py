"""Quality rules, ranked search and filter audit against brute force, on small tables with nulls, empties, ties and repeats."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from veilframe.llm import quality as Q
from veilframe.llm.filter_audit import COUNTS, filter_audit
from veilframe.llm.quality import estimate, quality
from veilframe.llm.ranked_search import ranked_search, terms

SPACE = re.compile("[\x20\x09-\x0d]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(text or "")


# --- quality rules ----------------------------------------------------------
def base(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


CLEAN = "The house of the old man stands in the valley and it was built with stone for a family that is gone. "
TEXTS = [None, "", " \n\t ", "one two three four five", "a b c d e a b c d e", "a b c d e f g h a b c d e f g h i j",
         "x " * 12, "line one here\nline one here\n \n\nother\x0bwords\x0cand\rmore", "#*$%&|<> " * 4 + "ü¡日本 é",
         CLEAN, " nbsp space " * 3, CLEAN * 3, "word " * 30_000, " ".join(f"w{i}" for i in range(20_000)),
         " ".join(f"w{i % 7_001}" for i in range(15_000))]


def test_quality_measures_match_brute_force(spark):
    rows = [(i, t, 1, "x", False) for i, t in enumerate(TEXTS)] + [(None, CLEAN, 2, "y", True), (9, CLEAN, 2, "y", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, words string, kept boolean")
    got = quality(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter(
        (i, *base(t)) for i, t, *_ in rows)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality(docs.where("doc_id = -1")).count() == 0


def votes_of(text):
    """The rules, said again in Python."""
    text = text or ""
    words, dense = words_of(text), "".join(words_of(text))
    lines = [x for x in text.split("\n") if words_of(x)]
    n, chars, symbols, dup, repeats, _ = base(text)
    letters = lambda cs: sum(1 for c in cs if c.isupper())
    share = lambda a, b: a / b if b else None
    plain = sum(1 for w in words if re.fullmatch(r"[^\W\d_]+[.,;:!?]?", w))
    loose = sum(1 for w in words if not any(c.isalnum() for c in w))
    stop = len(set(words) & set(Q.STOP_WORDS))
    by = {"symbols": share(symbols, n), "capitals": share(letters(dense), chars), "shouting": share(dense.count("!") + dense.count("?"), n),
          "repeats": share(repeats, n), "lines": share(dup, len(lines)) if len(lines) >= 5 else None, "loose": share(loose, n), "plain": share(plain, n),
          "variety": share(len(set(words)), n), "function": stop if n >= 50 else None, "length": n, "word_size": None if not n else abs(chars / n - 6)}
    out = []
    for name, _, good, bad in Q.RULES:
        x = by[name]
        yes, no = (False, False) if x is None else (x <= good, x > bad) if good < bad else (x >= good, x < bad)
        out.append(1 if yes else -1 if no else 0)
    return tuple(out)


def junk(rnd, i):
    words = [w for w in (CLEAN * 3).split() if w]
    rnd.shuffle(words)
    kind = i % 4
    if kind == 0:
        return " ".join(w + rnd.choice(["$$$", "###", "%%%"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " | ".join(words) if kind == 2 else "\n".join(["BUY | NOW | HERE"] * 30)


def test_posterior_equals_a_replay_and_separates(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        words = CLEAN.split() * 3
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, junk(rnd, i)) for i in range(30)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = [r[0] for r in Q.RULES]
    votes = {i: votes_of(t) for i, t in rows}
    assert {i: tuple(got[i][n] for n in names) for i, _ in rows} == votes
    prior, added = estimate(sorted((*v, n) for v, n in Counter(votes.values()).items()))
    for i, v in votes.items():
        want = 1 / (1 + math.exp(-(prior + sum(a.get(x, 0.0) for a, x in zip(added, v, strict=True)))))
        assert got[i].posterior == pytest.approx(want, abs=1e-9)
        assert got[i].kept == (not got[i].base_failed and want >= 0.5)
    assert all(got[i].kept for i in range(120) if not got[i].base_failed)
    assert not any(got[1000 + i].kept for i in range(30))


def test_em_learns_whom_to_trust():
    """A rule that votes at random loses its say; the others' accuracies come close to the truth."""
    rnd = random.Random(8)
    k, counts = len(Q.RULES), Counter()
    for _ in range(4000):
        good = rnd.random() < 0.7
        votes = [(1 if good else -1) * (1 if rnd.random() < 0.9 else -1) for _ in range(k)]
        votes[2] = rnd.choice([1, -1])
        votes[5] = 0
        counts[tuple(votes)] += 1
    prior, added = estimate(sorted((*v, n) for v, n in counts.items()))
    assert abs(prior - math.log(0.7 / 0.3)) < 0.2
    assert abs(added[2][1]) < 0.2 and abs(added[2][-1]) < 0.2
    assert all(abs(added[j][1] - math.log(9)) < 0.4 for j in range(k) if j not in (2, 5))
    assert estimate([]) == (0.0, [{-1: 0.0, 1: 0.0}] * k)


# --- ranked search ----------------------------------------------------------
def brute_search(docs, items, k):
    low = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, low(t)) for i, t in docs]
    texts = [(i, ts) for i, ts in texts if ts]
    n, total = len(texts), sum(len(ts) for _, ts in texts)
    df = Counter(t for _, ts in texts for t in set(ts))
    out = []
    for item, text in items:
        scored = []
        for i, ts in texts:
            m = 100 - 25 + (25 * len(ts) * n) // total
            tf = Counter(ts)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in low(text) if t in df)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [100_000, 5])
def test_ranked_search_equals_brute_force(spark, block):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "ABC", "x-y"]
    line = lambda n: " ".join(rnd.choice(vocabulary[:rnd.choice([8, 64])]) for _ in range(n))
    docs = [(i, line(rnd.randint(1, 40))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(7, docs[3][1]), (None, docs[3][1]), (None, line(5)), (300, None), (301, ""), (302, " .,- "), (303, line(20_000))]
    items = [(i, line(rnd.randint(1, 15))) for i in range(12)] + [(1, "w1 W1 w2 w2"), (20, None), (21, "..."), (22, "unknown words"), (None, "w3 ABC abc")]
    d = spark.createDataFrame([(i, t, 0, "z") for i, t in docs], "doc_id long, text string, row int, norm string").repartition(5)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, row int")
    got = ranked_search(d, b, k=7, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_search(docs, items, 7)
    assert ranked_search(d.where("doc_id = -1"), b).count() == 0 and ranked_search(d, b.where("item_id = -1")).count() == 0


def test_thresholds_close_buckets(spark):
    """Far more vectors than an item needs: the result is whole although most are never scored."""
    from veilframe.llm import ranked_search as R

    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"] if i % 50 == 0 else ["delta", "alpha"] if i % 3 else ["delta", "noise"]) for _ in range(30))) for i in range(3000)]
    items = [(0, "alpha beta gamma"), (1, "beta")]
    seen = []
    plain = R._row_sums
    R._row_sums = lambda values, starts: (seen.append(len(starts) - 1), plain(values, starts))[1]
    try:
        found = R.Items([(0, 0, 1), (1, 1, 1)], R.np.array([5, 7]), R.np.sqrt(R.np.array([5.0, 7.0])))
        frame = R.pd.DataFrame({"doc_id": range(5000), "norm": [100.0 - i / 50 for i in range(5000)], "terms": [[0]] * 5000, "impacts": [[int((100 - i / 50) / 5 ** 0.5)] for i in range(5000)]})
        top = R.pd.concat(R._search(found, 3, {0: 200})(iter([frame])))
    finally:
        R._row_sums = plain
    assert sorted(top["score"], reverse=True)[:3] == [220, 220, 220] and sum(seen) < 2500
    got = ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == brute_search(docs, items, 20)


def test_terms_fold_ascii_only():
    assert terms("ÀB-c d_e İ 日本x\x7f9") == [t.encode() for t in ["Àb", "c", "d", "e", "İ", "日本x", "9"]]


# --- filter audit -----------------------------------------------------------
def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    masks = {}
    for i, t, part in docs:
        text = t or ""
        w = words_of(text)
        fails = "".join(f for f, bad in zip("ABCDE", [
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            any(c in "#$%&*|" for c in text), i is not None and i > least[text]], strict=True) if bad)
        masks.setdefault(part or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, rows in masks.items():
        share = Counter()
        for order in permutations("ABCDE"):
            for fails, _, _ in rows:
                first = next((f for f in order if f in fails), None)
                share[first] += 1
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                c = Counter()
                for fails, g, t in rows:
                    gone, fail = bool(before & set(fails)), f in fails
                    c["kept"] += not gone and not fail
                    c["removed"] += not gone and fail
                    c["redundant"] += gone and fail
                    c["unique_fails"] += fails == f
                    c["good_lost"] += not gone and fail and g
                    c["toxic_lost"] += not gone and fail and t
                out[part, "".join(order), step + 1] = (*(c[x] for x in COUNTS), share[f])
    return out


def test_filter_audit_equals_brute_force(spark):
    rnd = random.Random(6)
    text = lambda: " ".join(rnd.choice(["Aa", "BB", "c", "d$", "e|", "f"]) + (str(rnd.randint(0, 400)) if rnd.random() < 0.9 else "")
                            for _ in range(rnd.choice([3, 99, 100, 140])))
    docs = [(i, text(), rnd.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(200 + i, docs[0][1], rnd.choice(["en", "de"])) for i in range(30)]
    docs += [(0, docs[0][1], "en"), (205, docs[0][1], "de"), (None, docs[0][1], "en"), (None, None, None), (300, None, "en"), (301, "", "fr"), (302, "w " * 30_000, "fr")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 300, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame([(*r, 0, "m") for r in docs], "doc_id long, text string, lang string, good int, mask string").repartition(4)
    b = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = filter_audit(d, b).collect()
    assert {(r.part, r.filter_order, r.step): (*(r[c] for c in COUNTS), r.shapley) for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * 4
    assert filter_audit(d.where("doc_id = -1"), b).count() == 0
    assert filter_audit(d, b.where("doc_id = -1")).agg(F.sum("good_lost")).first()[0] == 0
