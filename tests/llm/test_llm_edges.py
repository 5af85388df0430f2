"""Clashing column names, repeated and missing ids, lengths far apart, small weighted sources, and packing against the library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from veilframe.llm.ann import nearest  # noqa: E402
from veilframe.llm.line_dedup import line_dedup  # noqa: E402
from veilframe.llm.packing import MixturePlan, pack  # noqa: E402
from veilframe.llm.pii import mask_pii  # noqa: E402
from veilframe.llm.simhash import simhash_dedup  # noqa: E402
from veilframe.llm.tokens import load_tokenizer  # noqa: E402

CLASHES = ["_row", "_gone", "_g_id", "_g_row", "_p_id", "_p_row", "_p_spans", "_id", "_no_id", "row", "kept", "a.b"]


def with_clashes(df, *more):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate([*CLASHES, *more])])


def unclashed(row, names):
    return [row[c] for c in names]


def test_extra_columns_stay(spark):
    docs = with_clashes(spark.createDataFrame([(1, "first line of a text\nmail a@b.c"), (2, "First line of a text\nother"), (None, None)], "doc_id long, text string"))
    got = {r.doc_id: r for r in line_dedup(docs, short_lines=True).collect()}
    assert got[1].text == "first line of a text\nmail a@b.c" and got[2].text == "other" and got[None].text is None
    assert all(unclashed(r, CLASHES) == list(range(len(CLASHES))) for r in got.values())
    assert (got[2]["_dropped"], got[2]["_lines"]) == (1, 2)
    masked = {r.doc_id: r for r in mask_pii(docs).collect()}
    assert masked[1].text.endswith("mail <email>") and all(unclashed(r, CLASHES) == list(range(len(CLASHES))) for r in masked.values())
    own = line_dedup(with_clashes(docs.select("doc_id", "text"), "_dropped"), counts=("n_gone", "n_all"), short_lines=True)
    assert {"_dropped", "n_gone", "n_all"} <= set(own.columns) and {r["_dropped"] for r in own.collect()} == {len(CLASHES)}


PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old tree near the quiet river bank"
OTHER = "database engines sort rows before they merge them so that memory stays bounded even when one key holds most of the input"


def test_pipeline_keeps_unrelated_texts_of_one_id(spark):
    import corpus_pipeline as C

    rows = [(1, PROSE), (1, OTHER), (5, PROSE), (1, OTHER), (None, "x " + OTHER[::-1]), (None, "x " + OTHER[::-1]), (None, PROSE), (7, None), (8, "")]
    docs = with_clashes(spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows],
                                              "doc_id long, text string, lang string, source string, n_chars long"), "_dropped", "_lines")
    kept = C.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        [("1", PROSE), ("1", OTHER), ("None", "x " + OTHER[::-1]), ("7", "None")])
    assert C.near_duplicates(spark, docs.where("doc_id = -1"), "").count() == 0
    for stage in (C.lines, C.personal_data):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == len(rows)
        assert {r["_dropped"] for r in out.collect()} == {len(CLASHES)}


def test_simhash_keeps_large_ids_beside_null_ids(spark):
    big = 2**62 + 1
    got = simhash_dedup(spark.createDataFrame([(big, PROSE), (None, PROSE), (big + 1, OTHER)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted([(str(big), big), ("None", big), (str(big + 1), big + 1)])
    assert len({r.group for r in got}) == 2


@pytest.mark.parametrize("size", [1e-200, 1e30, 1e160, 1e300])
def test_nearest_of_lengths_far_apart(spark, size):
    g = np.random.default_rng(11)
    v = g.normal(size=(400, 16))
    v[::10] *= size
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = nearest(df, lambda i: (i % 20 == 0) | (i % 20 == 7), block_values=1600).collect()
    hits, queries = 0, [q for q in range(400) if q % 20 in (0, 7)]
    for q in queries:
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.cumsum(v * v[q], axis=1)[:, -1]
        want = [i for i in np.lexsort((np.arange(400), -score, ~np.isnan(score))) if i != q][:20]
        hits += len(set(want) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 20 * len(queries) and hits >= 0.97 * len(got)


def test_small_weighted_source_is_spread_over_the_windows():
    plan = MixturePlan({"big": 300_000, "tiny": 64}, {"big": 1000, "tiny": 1})
    at = [seq for _, size, seq, _ in plan.pieces("tiny", 0, 64) for _ in range(size)]
    # 2048 / 1001 ids are due a window, so all 31 windows that the source can fill hold 2 or 3
    assert len(at) == 64 and at == sorted(at) and set(np.bincount(at)[:31]) == {2, 3}
    for seed in range(20):
        rnd = random.Random(seed)
        totals = {q: rnd.choice([1, 3, 50, 4000, 90_000]) for q in "abcdef"}
        plan = MixturePlan(totals, {q: rnd.choice([0, 1e-9, 0.1, 1]) for q in "abcde"}, 64)
        ids = {}
        for q, n in totals.items():
            for start, size, seq, offset in plan.pieces(q, 0, n):
                assert size > 0
                for i in range(size):
                    assert ids.setdefault((seq, offset + i), (q, start + i)) == (q, start + i)
        assert len(ids) == sum(totals.values()) == len(set(ids.values()))


def test_weighted_small_source_has_its_own_queue(spark):
    path = P.path("byte_bpe_50k.json")
    rows = [(i, f"word{i} " * 2000, "big") for i in range(60)] + [(100 + i, "tiny text", "tiny") for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pack(df, path, 1, {"big": 0.5, "tiny": 0.5}, length=32).collect()
    assert {r.queue for r in got} == {"=big", "=tiny"}
    n_tiny = sum(r.length for r in got if r.queue == "=tiny")
    assert max(r.sequence_id for r in got if r.queue == "=tiny" and r.length) <= n_tiny // 16 or \
        sum(r.length for r in got if r.queue == "=tiny" and r.sequence_id < n_tiny // 16) == n_tiny // 16 * 16


def test_packing_equals_the_library_piece_by_piece(spark):
    path, t = P.path("byte_bpe_50k.json"), load_tokenizer(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = pack(docs, path, 1).collect()
    seen, seqs = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(piece) == r.length and r.ids_crc32 == zlib.crc32(piece.tobytes())
        seen[r.doc_id] = r.start + r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {d: len(x) for d, x in ids.items()}
    padding = 0
    for pieces in seqs.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding == 0 and sorted(seqs) == list(range(len(seqs)))
