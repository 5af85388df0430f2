"""Mixture-controlled packing: every window holds the sources in their target proportions."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import documents, stored
from veilframe.llm.tokens import encode_texts, id_type, load_tokenizer

LENGTH = 2048
MAX_QUEUES = 512
REST = "(rest)"  # all sources below a share of 1 in MAX_QUEUES, one queue


class MixturePlan:
    """Deficit round-robin over queues in closed form.

    A phase is a run of whole windows with fixed weights. After w of its windows
    the first k queues together have been given floor(w * length * share of
    the first k): each queue's deficit (its due less what it got) stays within one id
    and is carried from window to window, and any task can work out any window.
    Windows are always full. A phase ends when a queue cannot fill its next share;
    what that queue still has goes to the tail, and the others go on with
    their weights renewed. The tail is cut into full windows, then into sequences
    whose lengths are powers of two, which need no padding.
    """

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None = None, length: int = LENGTH):
        self.length, self.runs = length, {q: [] for q in totals}
        left = {q: n for q, n in sorted(totals.items()) if n}
        got = dict.fromkeys(left, 0)
        share = {q: left[q] if weights is None else round(weights.get(q, 0) * 10**6) for q in left}
        active, window, tail = list(left), 0, []
        while active:
            total = sum(share[q] for q in active)
            low = [q for q in active if share[q] * length < total or share[q] * length > total * left[q]]
            if low:  # less than an id a window, or less left than one window takes
                tail += low
                active = [q for q in active if q not in low]
                continue
            n = min(total * left[q] // (share[q] * length) for q in active)
            cum = 0
            for q in active:
                run = (got[q], window, n, cum, cum + share[q], total)
                cum += share[q]
                given = self._given(run, n)
                self.runs[q].append(run)
                got[q] += given
                left[q] -= given
            window += n
        at = 0
        for q in tail:
            if left[q]:
                self.runs[q].append((got[q], window, 0, at, at + left[q], 0))
                at += left[q]
        self.windows, self.tail = window, at
        self.starts = {q: [r[0] for r in runs] for q, runs in self.runs.items()}

    def _upto(self, w: int, cum: int, total: int) -> int:
        return w * self.length * cum // total

    def _given(self, run: tuple, w: int) -> int:
        _, _, _, lo, hi, total = run
        return self._upto(w, hi, total) - self._upto(w, lo, total)

    def _tail_place(self, x: int) -> tuple[int, int, int]:
        """Sequence, offset and room of tail position x."""
        full, rest = divmod(self.tail, self.length)
        if x < full * self.length:
            return self.windows + x // self.length, x % self.length, self.length - x % self.length
        x, seq = x - full * self.length, self.windows + full
        for b in reversed(range(rest.bit_length())):
            if rest >> b & 1:
                if x < 1 << b:
                    return seq, x, (1 << b) - x
                x, seq = x - (1 << b), seq + 1
        raise IndexError(x)

    def pieces(self, queue: str, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(first id, length, sequence, offset) of the pieces of ids start..start+n of a queue."""
        at, end, runs = start, start + n, self.runs[queue]
        i = bisect_right(self.starts[queue], at) - 1
        while at < end:
            if i + 1 < len(runs) and at >= runs[i + 1][0]:
                i += 1
            run = runs[i]
            first, window, n_windows, lo, hi, total = run
            stop = min(end, runs[i + 1][0]) if i + 1 < len(runs) else end
            y = at - first
            if total:
                w = min(y * total // ((hi - lo) * self.length), n_windows - 1)
                while self._given(run, w) > y:
                    w -= 1
                while self._given(run, w + 1) <= y:
                    w += 1
                size = min(stop - at, self._given(run, w + 1) - y)
                offset = self._upto(w + 1, lo, total) - self._upto(w, lo, total) + y - self._given(run, w)
                yield at - start, size, window + w, offset
            else:
                seq, offset, room = self._tail_place(lo + y)
                size = min(stop - at, room)
                yield at - start, size, seq, offset
            at += size


def queue_names(docs: DataFrame, max_queues: int = MAX_QUEUES) -> list[str]:
    """The sources with a queue of their own: those with more than 1 in
    ``max_queues`` of all bytes, so at most ``max_queues`` names reach the driver."""
    sizes = stored(docs.groupBy("queue").agg(F.sum(F.octet_length("text") + F.lit(1)).alias("n")), "packing-queues")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return sorted(r[0] for r in sizes.where(F.col("n") * max_queues > F.lit(total)).collect())


def encode_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Stored (block, doc_id, queue, before, n, ids): blocks are ranges of ids in
    ascending order, ``before`` counts the ids of the queue earlier in the block."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, width, seen = TaskContext.get().partitionId(), np.dtype(kind).itemsize, {}
        for b in batches:
            ids = list(encode_texts(b["text"], tokenizer, end_id))
            n = [len(x) // width for x in ids]
            before = []
            for q, k in zip(b["queue"], n, strict=True):
                before.append(seen.get(q, 0))
                seen[q] = before[-1] + k
            yield pd.DataFrame({"block": block, "doc_id": b["doc_id"].astype("Int64"), "queue": b["queue"], "before": before, "n": n, "ids": ids})

    kind = id_type(load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True))
    ranged = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "queue", "text")
    return stored(ranged.mapInPandas(encode, "block int, doc_id long, queue string, before long, n long, ids binary"), "packing-ids")


def pack(docs: DataFrame, tokenizer: str, end_id: int, weights: dict[str, float] | None = None, length: int = LENGTH,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack all documents into sequences; one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, queue.

    Each queue is a source in ascending id order; without ``weights`` the target
    proportions are the corpus's own, so all queues end together, and sources of less than 1 in
    MAX_QUEUES of the bytes share a queue. Every source with a weight has a queue of its own; sources
    without one, or due less than an id a window, come last, in the tail. Null texts count as
    empty (the end id alone), a null source is a queue of its own, null ids come
    first, rows that repeat an id are packed each. An empty table gives no rows.
    Only the three named columns are read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("(none)")).alias("queue"))
    names = sorted({*queue_names(docs), *("=" + k for k in weights or {})})
    own = F.col("queue").isin(names) if names else F.lit(False)
    blocks = encode_blocks(docs.withColumn("queue", F.when(own, F.col("queue")).otherwise(F.lit(REST))), tokenizer, end_id)
    sums = stored(blocks.groupBy("queue", "block").agg(F.sum("n").alias("n")), "packing-sums")
    totals = {r[0]: r[1] for r in sums.groupBy("queue").agg(F.sum("n")).collect()}  # a row per queue
    wanted = None if weights is None else {"=" + k: v for k, v in weights.items()}
    plan = MixturePlan(totals, wanted, length)
    earlier = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(sums.select("queue", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "packing-base")
    kind = id_type(load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            places, crcs, counts = [], [], []
            for queue, at, n, ids in zip(b["queue"], b["at"], b["n"], b["ids"], strict=True):
                wide = memoryview(np.frombuffer(ids, kind).astype("<u4").tobytes())
                own = list(plan.pieces(queue, at, n))
                places += own
                crcs += [zlib.crc32(wide[4 * start:4 * (start + size)]) for start, size, _, _ in own]
                counts.append(len(own))
            start, size, seq, offset = np.array(places, np.int64).reshape(-1, 4).T
            each = {c: b[c].repeat(np.array(counts, np.int64)).array for c in ("doc_id", "n", "queue")}
            yield pd.DataFrame({"doc_id": each["doc_id"], "start": start, "length": size, "ids_crc32": np.array(crcs, np.int64), "doc_tokens": each["n"],
                                "sequence_id": seq, "offset": offset, "queue": each["queue"]}).astype({"doc_id": "Int64"})

    placed = blocks.join(base, ["queue", "block"]).select("doc_id", "queue", (F.col("before") + F.col("base")).alias("at"), "n", "ids")
    return placed.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")


def op10_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
