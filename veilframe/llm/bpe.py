"""Byte-level BPE by DuckDB recursive queries inside Spark tasks."""

from __future__ import annotations

import base64
import hashlib
import tempfile
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import documents
from veilframe.llm.tokens import SEGMENT, WordCoder, segments

WORDS_PER_QUERY = 20_000
DECODE_TOKENS = 400_000   # tokens decoded by one query; longer documents go in blocks

SHORT = 64                # bytes of a word up to which a step contracts one pair

# One step contracts each word's leftmost pair of the smallest rank. Rows hold the next
# token too: the pair's second row becomes the product, its first row goes, and the row
# before learns the product; later places move up by one. Words without a pair that merges drop out.
ENCODE = """
WITH RECURSIVE step(i, w, p, t, u) AS (
  SELECT 0, w, p, t, u FROM start
  UNION ALL
  SELECT i + 1, w, CASE WHEN p > k THEN p - 1 ELSE p END, CASE WHEN p = k + 1 THEN id ELSE t END, CASE WHEN p = k - 1 THEN id ELSE u END
  FROM step JOIN (SELECT w, best >> 16 AS id, best & 65535 AS k
                  FROM (SELECT w, min((id << 16) + p) AS best FROM step JOIN merges ON pair = (t << 16) + u GROUP BY w)) USING (w)
  WHERE p <> k
)
SELECT w, t FROM step JOIN (SELECT w, max(i) AS i FROM step GROUP BY w) USING (w, i) ORDER BY w, p
"""

# For longer words, which may hold long runs, a step contracts all pairs of a word's
# smallest rank that would be next, from the left: this is so if no pair that
# holds the product ranks below it (``closed``), else only the leftmost goes.
ENCODE_LONG = """
WITH RECURSIVE step(i, w, p, t) AS (
  SELECT 0, w, p, t FROM start
  UNION ALL
  SELECT i + 1, w, p, CASE WHEN taken THEN best ELSE t END
  FROM (SELECT *, lag(taken, 1, false) OVER (PARTITION BY w ORDER BY p) AS eaten
        FROM (SELECT *, coalesce(m = best AND (nth = 1 OR closed) AND (p - first_p) % 2 = 0, false) AS taken
              FROM (SELECT *, row_number() OVER (PARTITION BY w, m ORDER BY p) AS nth,
                           min(p) OVER (PARTITION BY w, m, island) AS first_p
                    FROM (SELECT *, n - row_number() OVER (PARTITION BY w, m ORDER BY p) AS island
                          FROM (SELECT i, w, n AS p, n, t, id AS m, closed, min(id) OVER (PARTITION BY w) AS best
                                FROM (SELECT i, w, t, row_number() OVER (PARTITION BY w ORDER BY p) AS n,
                                             lead(t) OVER (PARTITION BY w ORDER BY p) AS u FROM step)
                                LEFT JOIN merges ON pair = t * 65536 + u)
                          WHERE best IS NOT NULL))))
  WHERE NOT eaten
)
SELECT w, t FROM step JOIN (SELECT w, max(i) AS i FROM step GROUP BY w) USING (w, i) ORDER BY w, p
"""
DECODE = "SELECT d, string_agg(piece, '' ORDER BY p) AS s FROM tokens JOIN ranks USING (id) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class DuckBPE:
    """The merge table in a private in-memory DuckDB of this worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        if max(self.ranks.values()) >= 65535:
            raise ValueError("ids of two bytes expected")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": tempfile.mkdtemp()})
        pairs = [(self.ranks[a], self.ranks[b], i) for token, i in self.ranks.items() for k in range(1, len(token))
                 if (a := token[:k]) in self.ranks and (b := token[k:]) in self.ranks]
        l, r, new = np.array(pairs, np.int64).reshape(-1, 3).T
        least = np.full(65536, 1 << 30)
        np.minimum.at(least, l, new)
        np.minimum.at(least, r, new)
        merges = pd.DataFrame({"pair": l * 65536 + r, "id": new, "closed": least[new] > new})
        ranks = pd.DataFrame({"id": list(self.ranks.values()), "piece": [k.decode("latin-1") for k in self.ranks]})
        for name, frame in (("merges", merges), ("ranks", ranks)):
            self.db.register("frame", frame)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM frame")
            self.db.unregister("frame")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.words: dict[str, bytes] = {}
        self.coder = WordCoder(self.code_chunks)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words by the recursive query."""
        out: list = [None] * len(words)
        hard = []
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = np.array([r], "<u2").tobytes()
            else:
                hard.append(i)
        hard.sort(key=lambda i: len(words[i]))  # words of a query need about as many steps
        short = bisect(hard, SHORT, key=lambda i: len(words[i]))
        for query, group in ((ENCODE, hard[:short]), (ENCODE_LONG, hard[short:])):
            for at in range(0, len(group), WORDS_PER_QUERY):
                some = group[at:at + WORDS_PER_QUERY]
                for i, ids in zip(some, self.contract(query, [words[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def contract(self, query: str, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)
        t = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        u = np.append(t[1:], -1)
        u[ends - 1] = -1  # no pair
        start = pd.DataFrame({"w": w, "p": np.arange(len(w)) - np.repeat(ends - sizes, sizes) + 1, "t": t, "u": u})
        self.db.register("start", start)
        got = self.db.execute(query).fetchnumpy()
        self.db.unregister("start")
        raw = np.asarray(got["t"]).astype("<u2").tobytes()
        stops = 2 * np.cumsum(np.bincount(got["w"], minlength=len(words)))
        return [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def code_chunks(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks: each match of the pattern is a word of its own."""
        cut = [self.pattern.findall(c) for c in chunks]
        new = list({w for words in cut for w in words})
        table = dict(zip(new, self.merge([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        return [b"".join([table[w] for w in words]) for words in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, group, size = [], [], 0
        for t in texts:
            if len(t) > SEGMENT:
                out += [b"".join(c) for c in self.coder.coded(group)] if group else []
                out.append(b"".join(b"".join(self.coder.coded([s])[0]) for s in segments(t)))
                group, size = [], 0
                continue
            group.append(t)
            size += len(t)
            if size > SEGMENT:
                out += [b"".join(c) for c in self.coder.coded(group)]
                group, size = [], 0
        return out + ([b"".join(c) for c in self.coder.coded(group)] if group else [])

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of id sequences by the ordered aggregation."""
        out: list[list[bytes]] = [[] for _ in packed]
        todo, size = [], 0
        blocks = [(i, p[a:a + 2 * DECODE_TOKENS]) for i, p in enumerate(packed) for a in range(0, len(p), 2 * DECODE_TOKENS)]
        for i, block in [*blocks, (-1, b"")]:
            if todo and (i < 0 or size + len(block) // 2 > DECODE_TOKENS):
                sizes = np.array([len(b) // 2 for _, b in todo])
                ids = np.frombuffer(b"".join([b for _, b in todo]), "<u2").astype(np.int64)
                tokens = pd.DataFrame({"d": np.repeat(np.arange(len(todo)), sizes), "p": np.arange(len(ids)), "id": ids})
                self.db.register("tokens", tokens)
                found = dict(self.db.execute(DECODE).fetchall())
                self.db.unregister("tokens")
                for k, (doc, _) in enumerate(todo):
                    out[doc].append(found[k].encode("latin-1"))
                todo, size = [], 0
            todo.append((i, block))
            size += len(block) // 2
        return [b"".join(x) for x in out]


_BPE: dict[tuple[str, str], DuckBPE] = {}


def bpe_roundtrip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): packed two-byte ids of every whole text, and the bytes decoded from them.

    Null texts count as empty and have no ids. Repeated rows and null ids are encoded
    like any other; an empty table gives an empty result; only the two named
    columns are read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (ranks, pattern) not in _BPE:
            _BPE[ranks, pattern] = DuckBPE(ranks, pattern)
        bpe = _BPE[ranks, pattern]
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at:at + 500]
                ids = bpe.encode([t or "" for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "ids": ids, "decoded": bpe.decode(ids)})

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInPandas(run, "doc_id long, ids binary, decoded binary")


def _wide_sha():
    @F.pandas_udf("string")
    def sha(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: hashlib.sha256(np.frombuffer(x, "<u2").astype("<u4").tobytes()).hexdigest())
    return sha


def op6_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers as P

    got = bpe_roundtrip(documents(spark, sf_dir), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return got.select("doc_id", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"), _wide_sha()("ids").alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
