"""The corpus operators against brute force, on small tables with nulls, empties, ties and repeats."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from veilframe.llm import line_dedup as LD  # noqa: E402
from veilframe.llm.ann import nearest  # noqa: E402
from veilframe.llm.bpe import bpe_roundtrip  # noqa: E402
from veilframe.llm.exact_dedup import exact_dedup  # noqa: E402
from veilframe.llm.packing import MixturePlan, pack  # noqa: E402
from veilframe.llm.pii import find_pii, mask_pii  # noqa: E402
from veilframe.llm.simhash import fingerprint, simhash_dedup  # noqa: E402
from veilframe.llm.token_counts import token_counts, unigram_vocabulary  # noqa: E402
from veilframe.llm.token_files import PerfectHash, TokenFiles  # noqa: E402
from veilframe.llm.tokens import load_tokenizer  # noqa: E402
from veilframe.llm.toxicity import _codes, similarity, toxicity  # noqa: E402

TEXTS = [(3, "Same Text here"), (1, "same text HERE"), (2, None), (4, ""), (5, "ÀB c"), (6, "àb c"), (7, "a  b \n c."), (7, "a  b \n c."),
         (None, "no id"), (9, "word " * 3000), (10, "<|endoftext|> it's 12345 日本 \0x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in TEXTS], "doc_id long, text string, row string, h int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def norm(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_dedup(docs, empty, bits):
    got = exact_dedup(docs, capacity=3, hash_bits=bits).collect()
    assert len(got) == len(TEXTS) and exact_dedup(empty).count() == 0
    by = {}
    for i, t in TEXTS:
        by.setdefault(norm(t), []).append(i)
    want = sorted((str(i), max((x for x in by[norm(t)] if x is not None), default=None), len(by[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_simhash_links_match_all_pairs(spark, docs, empty):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") * 2 for _ in range(150)) for _ in range(6)]
    rows = []
    for i in range(90):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r for r in simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: fingerprint(t) for i, t in rows}
    label = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    assert {i: r.component_id for i, r in got.items()} == label
    assert all(r.fingerprint == f"{fps[i]:016x}" for i, r in got.items())
    assert simhash_dedup(docs).count() == len(TEXTS) and simhash_dedup(empty).count() == 0
    assert fingerprint(None) == fingerprint(" \n") == 0 and fingerprint("A b") == fingerprint("a  B")


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return int(a != b) if a[i + (len(a) == len(b)):] == b[i + 1:] else 2


def test_line_dedup_keeps_the_earliest(spark, docs, empty):
    rnd = random.Random(3)
    base = ["the quick brown fox jumps over", "a aa aaa aaaa aaaaa b", "Été à la plage de nice", "short one"]

    def edit(s):
        i = rnd.randrange(len(s))
        return s[:i] + rnd.choice(["", "x", "é", s[i] + "b"]) + s[i + 1:]
    rows = [(i, "\n".join(edit(edit(rnd.choice(base))) if rnd.random() < .5 else rnd.choice(base) for _ in range(5))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n")]
    want, seen = {}, []
    for i, t in rows:
        kept = []
        for x in (t or "").split("\n"):
            n = norm(x.strip(" "))
            if len(re.split(r"\s+", n)) < LD.MIN_WORDS or not any(edits(n, y) <= 1 for y in seen):
                kept.append(x)
            if len(re.split(r"\s+", n)) >= LD.MIN_WORDS:
                seen.append(n)
        want[i] = None if t is None else "\n".join(kept)
    rnd.shuffle(rows)
    assert {r.doc_id: r.text for r in LD.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert LD.line_dedup(docs).count() == len(TEXTS) and LD.line_dedup(empty).count() == 0


def test_lines_within_an_edit_meet_in_a_shared_region():
    rnd = random.Random(9)
    emitted = whole = 0
    for _ in range(1500):
        n = rnd.choice([1, 9, 15, 16, 17, 32, 33, 100, 313])
        a = "".join(rnd.choice("abé ") for _ in range(n))
        i = rnd.randrange(n)
        pair = [a, a[:i] + rnd.choice(["x", "", "x" + a[i]]) + a[i + 1:]]
        rnd.shuffle(pair)
        keys = [LD.region_keys(x).tolist() for x in pair]
        shared = set(keys[0]) & set(keys[1])
        (v, kind), (w, other) = (LD.variant_keys(x, [r for r, k in enumerate(own) if k in shared]) for x, own in zip(pair, keys, strict=True))
        met = {(v[p], kind[p], other[q]) for p in range(len(v)) for q in np.flatnonzero(w == v[p])}
        assert {(s, o) for _, s, o in met} & {(LD.SWAP, LD.SWAP), (LD.CUT, LD.OWN), (LD.OWN, LD.CUT)}, pair
        if n > 100:
            emitted, whole = emitted + len(v) + len(w), whole + sum(len(LD.variant_keys(x)[0]) for x in pair)
    assert emitted * 5 < whole  # all deletions were emitted before


def test_alike_halves_alone_emit_no_variants(spark, monkeypatch):
    same = "the same first half of a line that is long enough to be seen "
    rows = [(i, same + f"{i * 7919 % 1009:04d} and {i * 104729 % 9973:05d} with {i * 31 % 997:03d} other words {i:05d}") for i in range(300)]
    rows += [(1000, rows[7][1].replace("other", "othar")), (1001, rows[8][1].replace("first", "firsst"))]
    kept = {}

    def stored(df, name, *args):
        kept[name] = LD_STORED(df, name, *args)
        return kept[name]

    LD_STORED = LD.stored
    monkeypatch.setattr(LD, "stored", stored)
    got = {r.doc_id: r.text for r in LD.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, t in got.items() if not t} == {1000, 1001}
    assert kept["line-some"].count() == 302 and kept["line-variants"].select("sid").distinct().count() == 4


def test_line_dedup_of_short_and_unspaced_lines(spark):
    long = "本日は晴天なり" * 6
    rows = [(1, "All rights reserved.\nok\n\nPage 1\n" + long), (2, "all rights reserved. \nOK\n\n\nPage 2\n" + long + "x"),
            (3, "new\n" + long[1:] + "\nnew\n \n"), (4, None), (5, "ok")]
    got = LD.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), short_lines=True).collect()
    assert {r.doc_id: r.text for r in got} == {1: rows[0][1], 2: "\n\nPage 2", 3: "new\n \n", 4: None, 5: ""}


def test_query_and_pipeline_leave_no_repeated_line(spark):
    import corpus_pipeline as C

    texts = [(1, "All rights reserved.\none"), (2, "all rights reserved.\ntwo")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in C.lines(spark, docs, "").collect()} == {1: texts[0][1], 2: "two"}
    path = "/root/testdata/sf0.001"
    kept = {r.doc_id: r.n_lines - r.n_dropped for r in LD.op3_line_dedup(spark, path).collect()}
    lines = [norm(x.strip(" ")) for r in LD.documents(spark, path).collect() for x in (r.text or "").split("\n")]
    blank = sum(not x.strip() for x in lines)
    assert sum(kept.values()) <= len({x for x in lines if x.strip()}) + blank


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    mph = PerfectHash.load(*PerfectHash.build(keys).dump())
    assert sorted(mph.slots(keys)) == list(range(5000))
    same = PerfectHash.build(np.array([7, 7, 9], np.uint64))
    assert set(same.slots(np.array([9], np.uint64))) <= {0, 1, 2}


def test_token_files_round_trip(docs, empty):
    path = P.path("word_bpe_49k.json")
    files = TokenFiles(docs, path, 2)
    got = files.get(files.catalogue.select("doc_id", "nth")).collect()
    t = load_tokenizer(path)
    want = sorted((str(i), tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x in TEXTS)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in got) == want
    missing = docs.sparkSession.createDataFrame([(999, 0)], "doc_id long, nth int")
    assert files.get(missing).count() == 0
    none = TokenFiles(empty, path, 2)
    assert none.get(none.catalogue.select("doc_id", "nth")).count() == 0


def test_token_file_query_holds_one_python_worker_per_task(spark, docs, tmp_path, monkeypatch):
    from veilframe.llm import token_files

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(token_files, "READ", 64)  # rows go back in slices
    got = token_files.op4_token_files(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "ArrowEvalPython" not in plan  # the checksum took a second worker in the same task before
    t = load_tokenizer(P.path("word_bpe_49k.json"))
    want, at = [], 0
    for i, x in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        if i is not None:  # the query's keys are joined by id
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in got.collect() if r.doc_id is not None) == sorted(want)


def test_similarity_tolerates_gaps():
    s = similarity(["idiot", "id-iot", "idxiot", "banana"], ["idiot"] * 4)
    assert s[0] == pytest.approx(1) and min(s[1:3]) > 0.5 > 0.2 > s[3]


def test_no_word_like_a_landmark_is_skipped():
    from veilframe.llm.toxicity import FLOOR, LandmarkSimilarities

    marks = ["worthless", "stupid", "réeuxment", "boment", "achlichachli"]
    rnd = random.Random(6)
    words = {"thless", "stup", "worth", "eux", "ré"} | {"".join(rnd.choice(x) for _ in range(rnd.randint(3, 12))) for x in marks for _ in range(300)}
    words |= {x[i:j] + y for x in marks for i in range(len(x)) for j in range(i + 2, len(x) + 1) for y in ("", "zk")}
    words = sorted(w for w in words if len(w) >= 3)
    sims = LandmarkSimilarities(marks)
    sims.learn(words)
    for m, mark in enumerate(marks):
        want = similarity(words, [mark] * len(words))
        got = np.array([0.0 if sims.cache[w] is None else sims.cache[w][m] for w in words])
        sure = np.abs(want - FLOOR) > 1e-4
        assert np.allclose(np.where(want >= FLOOR, want, 0)[sure], got[sure], atol=1e-4)


def test_words_of_the_same_letters_are_told_together():
    from veilframe.llm.toxicity import DECAY, LandmarkSimilarities, kernel

    words = ["".join(x) for x in itertools.permutations("stupid")][:300]
    sims, asked = LandmarkSimilarities(["stupid", "pit"]), []
    told = sims._reachable
    sims._reachable = lambda m, shared: asked.append(len(shared)) or told(m, shared)
    sims.learn(words)
    assert asked == [1, 1]  # 300 each before
    rnd = random.Random(4)
    for _ in range(30):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(2))
        want = sum(DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1) for i in itertools.combinations(range(len(a)), 3)
                   for j in itertools.combinations(range(len(b)), 3) if [a[k] for k in i] == [b[k] for k in j])
        assert kernel(_codes([a], 7), _codes([b], 7))[0] == pytest.approx(want, rel=1e-5)


def test_words_are_encoded_together():
    from veilframe.llm import tokens as K

    class Counting:
        def __init__(self, t):
            self.t, self.strings = t, 0

        def __getattr__(self, name):
            return getattr(self.t, name)

        def encode_batch_fast(self, strings, **kw):
            self.strings += len(strings)
            return self.t.encode_batch_fast(strings, **kw)

    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("aeiolmnrstué") for _ in range(rnd.randint(1, 12))) for _ in range(2000)} | {"ﬁn", "ςσ", "i̇x", "中文"})
    for name, space in (("word_bpe_49k.json", ""), ("byte_bpe_50k.json", " ")):
        t = Counting(load_tokenizer(P.path(name)))
        got = K._batch_code(t, "<u2")([space + w for w in words])
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [t.encode(space + w, add_special_tokens=False).ids for w in words]
        assert t.strings < len(words) / 3  # of word_bpe, every word went alone before


def test_distinct_chunks_are_looked_up_once():
    from veilframe.llm import tokens as K

    rnd = random.Random(8)
    some = ["the", "The", "éa", " ", "\n", "\n\n", ".", ",", "\t", "a\u0301", "\0", "İ", "中文", "don't", "12", "\r\n", "🙂", ""]
    texts = ["", "\n", " x", "a\nb", "a  b", *("".join(rnd.choice(some) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 30))) for _ in range(300))]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = load_tokenizer(P.path(name))
        coder, kind = K.id_coder(P.path(name))
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert [np.frombuffer(x, kind).tolist() for x in K.joined_codes(coder, texts, kind)] == want
        assert [np.frombuffer(x, kind).tolist()[:-1] for x in K.encode_texts([None, *texts], P.path(name), 2)] == [[], *want]
        asked = []

        class Seen(dict):
            def get(self, c, default=None):
                asked.append(c)
                return super().get(c, default)

        coder.young = Seen(coder.young)
        K.joined_codes(coder, ["one two three"] + ["two three"] * 50, kind)
        assert len(asked) <= 10  # by every word before
        coder.young = dict(coder.young)


def test_words_are_looked_up_without_the_marks_after_them():
    from veilframe.llm import tokens as K

    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(8)) for _ in range(40)] + ["İ", "a\u0301", "12", "é"]
    texts = [" ".join(w + "".join(rnd.choice(K.MARKS) for _ in range(rnd.randint(0, 2))) for w in rnd.choices(words, k=400)) for _ in range(5)]
    texts += [",", ", a,", "a,\nb,\n", "x\n,", "z" + "-" * 300, "\0a, b,", " .", "a,  b."]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = load_tokenizer(P.path(name))
        kind = K.id_type(t.get_vocab_size(with_added_tokens=True))
        coder = type(K.id_coder(P.path(name))[0])(K._batch_code(t, kind), limit=30)
        for _ in range(3):  # new, young and old entries
            assert [np.frombuffer(x, kind).tolist() for x in K.joined_codes(coder, texts, kind)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        coder.limit, coder.young, coder.old = 10**6, {}, {}
        K.joined_codes(coder, [" ".join(w + m for w in words[:40] for m in K.MARKS)], kind)
        assert len(coder.young) <= 80 + len(K.MARKS)  # each word with each mark before


def test_toxicity_held_out(spark, empty):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aelmnrsu") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(20)]
        if i % 5 == 0:
            w[3] = rnd.choice(["blockhead", "nitwit"]) if i < 500 else "nit.wit"
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows + [(700, None), (None, ""), (701, "")], "doc_id long, text string")
    got = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_toxicity_learns_stems_and_repeated_use(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aelmnrsu") for _ in range(6)) for _ in range(300)]

    def ending():
        return "".join(rnd.choice("bcdfgiopt") for _ in range(4))
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(words) for _ in range(40)]
        if i % 9 == 0:  # a stem whose full words do not recur
            w[3] = "achlik" + ending()
        for k in range(4 if i % 9 == 1 else i % 3 == 2):  # clean documents hold this one once
            w[7 * k + 5] = "bomzat" + ending()
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(i % 9 < 2)))
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    for kind in (0, 1):
        mine = [r.predicted for r in held if r.doc_id % 9 == kind]
        assert len(mine) > 10 and sum(mine) >= 0.9 * len(mine)
    clean = [r.predicted for r in held if r.doc_id % 9 > 1]
    assert sum(clean) <= 0.05 * len(clean)


def test_bpe_equals_the_library(docs, empty):
    import tiktoken

    from veilframe.llm.bpe import read_ranks

    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    got = bpe_roundtrip(docs, path, P.PATTERN).collect()
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u2").tolist()), bytes(r.decoded)) for r in got) == sorted(
        (str(i), tuple(lib.encode_ordinary(t or "")), (t or "").encode()) for i, t in TEXTS)
    assert bpe_roundtrip(empty, path, P.PATTERN).count() == 0


def test_bpe_of_long_and_short_words():
    import tiktoken

    from veilframe.llm.bpe import SHORT, DuckBPE

    path, rnd = P.path("byte_bpe_50k.tiktoken"), random.Random(8)
    bpe = DuckBPE(path, P.PATTERN)
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = ["a" * n for n in (1, 2, 3, SHORT - 1, SHORT, SHORT + 1, 5000)] + ["=" * 70 + "ab" * 90 + "\n" * 300, "日本" * 200]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 150))) for letters in ("ab", "etaoin", "é日x ") for _ in range(60)]
    ids = bpe.encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in ids] == [lib.encode_ordinary(t) for t in texts]
    assert bpe.decode(ids) == [t.encode() for t in texts]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((2 * int(c) // 10 + 2 * int(c) % 10) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_pii_base_spans(spark, docs, empty):
    rnd = random.Random(9)
    bits = ["a@b.c", "x@y", "_d@e.f", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713",
            "+44 20", " ", "é", "\n", "é日", "-", ".", "7" * 30, "token = \"04dbebab91ab85687d33eeaaf9\""]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(12))) for i in range(150)] + [(150, "5" * 20_000), (151, "a" * 20_000), (152, "a@b.c " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in find_pii(df).collect()}
    for i, t in rows:
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if passes(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:100]
        assert set(want) <= set(got[i].spans.split(",")) | {""}
    assert find_pii(docs).count() == len(TEXTS) and find_pii(empty).count() == 0
    masked = {r.doc_id: r.text for r in mask_pii(spark.createDataFrame([(1, "é a@b.c x 1.2.3.4"), (2, None), (3, "no")], "doc_id long, text string")).collect()}
    assert masked == {1: "é <email> x <ip>", 2: None, 3: "no"}


def test_nearest_equals_brute_force(spark):
    g = np.random.default_rng(4)
    v = g.normal(size=(400, 16))
    v[30:60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None]), (404, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, lambda i: i % 20 == 0, block_values=1600).orderBy("query_id", "rank").collect()
    hits = 0
    for q in range(0, 400, 20):
        score = np.cumsum(v * v[q], axis=1)[:, -1]
        want = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        hits += len(set(want) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.97 * 400 and len(got) == 400
    assert nearest(df.where("vec_id < 0"), lambda i: i % 20 == 0).count() == 0


def test_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer, models

    path = P.path("piece_bpe_32k.model")
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *unigram_vocabulary(path)], unk_id=0, byte_fallback=True))
    want = sorted((str(i), len(lib.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts(docs, path).collect()) == want
    assert token_counts(empty, path).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 0.2, "b": 0.7, "d": 0.1}])
def test_mixture_plan_fills_every_window(weights):
    totals, rnd, seqs = {"a": 100_000, "b": 30_000, "c": 5, "d": 7_777}, random.Random(1), {}
    plan = MixturePlan(totals, weights)
    for q, n in totals.items():
        at = 0
        while at < n:
            k = min(rnd.randint(1, 3000), n - at)
            assert sum(size for _, size, _, _ in plan.pieces(q, at, k)) == k
            for _, size, seq, offset in plan.pieces(q, at, k):
                seqs.setdefault(seq, []).append((offset, size))
            at += k
    lengths = []
    for seq in range(len(seqs)):
        end = 0
        for offset, size in sorted(seqs[seq]):
            assert offset == end
            end += size
        lengths.append(end)
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths) and sum(lengths) == sum(totals.values())


def test_pack_holds_every_id_once(docs, empty):
    path = P.path("byte_bpe_50k.json")
    rows = pack(docs, path, 1, source_col="row").collect()
    t = load_tokenizer(path)
    assert sum(r.length for r in rows) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in TEXTS)
    assert pack(empty, path, 1, source_col="row").count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash", "pii", "packing"]
    rows = C.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and rows.where(F.col("length") > 2048).count() == 0
