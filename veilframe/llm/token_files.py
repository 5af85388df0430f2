"""Token-id shards in ascending document order, with a minimal perfect hash index for keyed access."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import documents, scratch, stored
from veilframe.llm.tokens import encode_texts, id_type, load_tokenizer

KEYS_PER_PART = 50_000
GAMMA = 2.0        # bits per key and level of the perfect hash
MAX_LEVELS = 48    # keys left after these (equal hashes only) are listed
FINGERPRINT = 101  # salt of the stored fingerprints
READ = 1 << 23     # bytes of ids that a reader hands on at a time

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A salted 64-bit finaliser over an array of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by levels of bit arrays: a key that is alone on its bit
    stays there, the others go on to the next level; a key's slot is the number
    of set bits before its own."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before = np.cumsum([0] + [int(b.sum()) for b in levels])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < MAX_LEVELS:
            m = int(GAMMA * len(keys)) + 8 & ~7
            at = (mix(keys, len(levels)) % np.uint64(m)).astype(np.int64)
            n = np.bincount(at, minlength=m)
            levels.append((n == 1).astype(np.int64))
            keys = keys[n[at] != 1]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; for a key that was not built in, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[todo], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[todo[hit]] = self.before[k] + self.ranks[k][at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.before[-1] + at[hit]
        return out

    def dump(self) -> tuple[list[int], bytes, bytes]:
        return ([len(b) for b in self.levels], b"".join(np.packbits(b.astype(np.uint8)).tobytes() for b in self.levels),
                self.rest.tobytes())

    @classmethod
    def load(cls, sizes, bits: bytes, rest: bytes) -> PerfectHash:
        every, at, levels = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.int64), 0, []
        for n in sizes:
            levels.append(every[at:at + n])
            at += n
        return cls(levels, np.frombuffer(rest, np.uint64))


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encode and write raw ids: one shard file per range of ids, ascending.

    Returns the stored catalogue (doc_id, nth, shard, at, n_tokens): ``nth``
    counts rows of one id. A shard is written under a name of its attempt and
    then renamed, so a repeated task replaces it with the same bytes.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, base = _open(folder)
        temp, at, last, nth, out = f"{base}/_{attempt}", 0, ("none",), 0, None
        for b in batches:
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(temp)
            rows = []
            for key, ids in zip(b["doc_id"], encode_texts(b["text"], tokenizer, end_id), strict=True):
                key = None if pd.isna(key) else int(key)
                nth = nth + 1 if key == last else 0
                last = key
                out.write(ids)
                rows.append((key, nth, shard, at, len(ids) // width))
                at += len(ids) // width
            yield pd.DataFrame(rows, columns=["doc_id", "nth", "shard", "at", "n_tokens"]).astype({"doc_id": "Int64"})
        if out is not None:
            out.close()
            fs.move(temp, f"{base}/{shard:06d}.ids")

    width = np.dtype(id_type(load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True))).itemsize
    ranged = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ranged.mapInPandas(write, "doc_id long, nth int, shard int, at long, n_tokens long"), "token-catalogue")


def _parts(spark_rows: int) -> int:
    return max(1, -(-spark_rows // KEYS_PER_PART))


def build_index(catalogue: DataFrame, parts: int) -> DataFrame:
    """The stored index: per hash part a perfect hash and, by slot, the stored
    fingerprint, shard, place and length."""
    def build(b: pd.DataFrame) -> pd.DataFrame:
        keys = b["key"].to_numpy(np.int64).view(np.uint64)
        mph = PerfectHash.build(keys)
        order = np.argsort(mph.slots(keys))
        rec = np.zeros(len(keys), [("fp", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])
        rec["fp"], rec["shard"], rec["at"], rec["n"] = mix(keys, FINGERPRINT) >> np.uint64(32), b["shard"], b["at"], b["n_tokens"]
        sizes, bits, rest = mph.dump()
        return pd.DataFrame({"part": b["part"][:1], "sizes": [sizes], "bits": [bits], "rest": [rest], "slots": [rec[order].tobytes()]})

    return stored(_keyed(catalogue, parts).groupBy("part").applyInPandas(
        build, "part int, sizes array<int>, bits binary, rest binary, slots binary"), "token-index")


def _keyed(rows: DataFrame, parts: int) -> DataFrame:
    key = F.xxhash64("doc_id", "nth")
    return rows.withColumn("key", key).withColumn("part", F.pmod(F.xxhash64(key, F.lit(7)), F.lit(parts)).cast("int"))


def lookup(keys: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """(doc_id, nth) -> shard, at, n_tokens for the keys that the index holds."""
    def find(k: pd.DataFrame, ix: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"doc_id": [], "nth": [], "shard": [], "at": [], "n_tokens": []})
        if not len(k) or not len(ix):
            return empty
        r = ix.iloc[0]
        mph = PerfectHash.load(r["sizes"], r["bits"], r["rest"])
        rec = np.frombuffer(r["slots"], [("fp", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])
        x = k["key"].to_numpy(np.int64).view(np.uint64)
        slot = mph.slots(x)
        hit = (slot >= 0) & (rec["fp"][slot] == (mix(x, FINGERPRINT) >> np.uint64(32)).astype(np.uint32))
        got = rec[slot[hit]]
        return pd.DataFrame({"doc_id": k["doc_id"][hit].astype("Int64"), "nth": k["nth"][hit], "shard": got["shard"].astype(np.int32),
                             "at": got["at"].astype(np.int64), "n_tokens": got["n"].astype(np.int64)})

    return _keyed(keys, parts).groupBy("part").cogroup(index.groupBy("part")).applyInPandas(
        find, "doc_id long, nth int, shard int, at long, n_tokens long")


def read_ids(places: DataFrame, folder: str, kind: str, packed: str | None = None) -> DataFrame:
    """Read the ids of looked-up places back from the shard files: adds ``ids``, packed as type ``packed``
    (default: as in the files). Rows go back whenever they hold ``READ`` bytes of ids."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(folder)
        width, shard, f = np.dtype(kind).itemsize, None, None
        for b in batches:
            b = b.assign(doc_id=b["doc_id"].astype("Int64"))
            ids, size, done = [], 0, 0
            for s, at, n in zip(b["shard"], b["at"], b["n_tokens"], strict=True):
                if s != shard:
                    f, shard = fs.open_input_file(f"{base}/{s:06d}.ids"), s
                f.seek(at * width)
                raw = f.read(n * width)
                ids.append(np.frombuffer(raw, kind).astype(packed).tobytes() if packed else raw)
                size += len(ids[-1])
                if size >= READ:
                    yield b[done:done + len(ids)].assign(ids=ids)
                    done += len(ids)
                    ids, size = [], 0
            if ids:
                yield b[done:].assign(ids=ids)

    return places.repartition("shard").sortWithinPartitions("shard", "at").mapInPandas(
        read, "doc_id long, nth int, shard int, at long, n_tokens long, ids binary")


class TokenFiles:
    """Written token files: ``folder`` of shards, ``catalogue``, ``index``."""

    def __init__(self, docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"):
        """Encode every whole text (null: empty), add ``end_id`` and write.

        Rows go out in ascending id order, null ids first; rows that repeat an id
        are kept apart by their number. An empty table has no shards. Only the
        two named columns are read.
        """
        spark: SparkSession = docs.sparkSession
        self.kind = id_type(load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True))
        self.folder = scratch(spark, "token-shards")
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.catalogue = write_shards(docs, tokenizer, end_id, self.folder)
        self.parts = _parts(self.catalogue.count())
        self.index = build_index(self.catalogue, self.parts)

    def get(self, keys: DataFrame, packed: str | None = None) -> DataFrame:
        """Ids of the keys (doc_id, nth) through index and files, packed as in the files or as type ``packed``."""
        return read_ids(lookup(keys, self.index, self.parts), self.folder, self.kind, packed)

    def shard_starts(self) -> DataFrame:
        """(shard, base): ids in all shards before; a row per shard."""
        sums = self.catalogue.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def op4_token_files(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    files = TokenFiles(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    keys = docs.groupBy("doc_id").count().select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("nth"))
    got = files.get(keys, "<u4").join(stored(files.shard_starts(), "shard-starts"), "shard")
    return got.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))
