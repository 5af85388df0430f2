"""Line dedup: equal lines, and lines within one character edit by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import ascii_lower, documents, ref, stored, unused
from veilframe.llm.token_files import mix

MIN_WORDS = 5   # lines of fewer words, unless as long as LONG, are not compared for near ones: they are near by chance
LONG = 32       # characters from which a line is compared for near ones whatever its words (text without spaces)
MAX_EDITS = 1   # character edits between near lines
BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


EMIT_CHARS = 1 << 16  # about the characters of lines whose keys go out together
REGIONS = 16    # parts of a line; two lines within one edit agree outside one of them
OWN, CUT, SWAP = 0, 1, 2  # what a key stands for: the line itself, a deletion, a deletion at a known place


def _sums(line: str) -> np.ndarray:
    """Running sums of code * BASE^place, modulo 2^64, from 0 to the whole line."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), BASE, np.uint64))), dtype=np.uint64)[:-1]
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers, dtype=np.uint64)))


def _bounds(n: int) -> np.ndarray:
    """Where the regions of a line of n characters begin, and n."""
    return np.arange(REGIONS + 1) * n // REGIONS


def region_keys(line: str) -> np.ndarray:
    """Hashed keys of a line less one region: REGIONS keys as the shorter or equal line of a
    pair within one edit, then as the longer one.

    Both lines of a pair count regions by the shorter length. The edit lies in one region, or at its end, and
    what comes before and after it is the same in both, so they share its key.
    """
    sums, n = _sums(line), len(line)
    number = np.arange(REGIONS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        at = _bounds(n)
        own = mix(mix(sums[at[:-1]], n) + number, 5) + (sums[-1] - sums[at[1:]])
        if not n:
            return own
        at = _bounds(n - 1)
        longer = mix(mix(sums[at[:-1]], n - 1) + number, 5) + (sums[-1] - sums[at[1:] + 1]) * np.uint64(INVERSE)
    return np.concatenate((own, longer))


def variant_keys(line: str, regions: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys of a line and its single-character deletions, and what each stands for.

    Two lines are one insertion apart if the longer one's deletion is the other
    line itself (CUT meets OWN), and one substitution apart if they are equal without
    the same place (SWAP meets SWAP). With S the running sum of code * BASE^place
    (modulo 2^64), the line without place i has the sum S[i] + (S[n] - S[i+1]) / BASE,
    so all keys cost one pass. ``regions`` are places in ``region_keys``: only deletions
    by which a line that shares such a key can be met are given.
    """
    sums, n = _sums(line), len(line)
    cuts = swaps = np.arange(n)
    if regions is not None:
        def places(ends: list[tuple[int, int]]) -> np.ndarray:
            return np.unique(np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in ends)]))
        own, longer = _bounds(n), _bounds(max(0, n - 1))
        swaps = places([(own[r], own[r + 1]) for r in regions if r < REGIONS])
        cuts = places([(longer[r - REGIONS], longer[r - REGIONS + 1] + 1) for r in regions if r >= REGIONS])
    with np.errstate(over="ignore"):
        shorter = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(INVERSE)
        cut = mix(np.unique(shorter[cuts]), n - 1)
        swap = mix(mix(shorter[swaps], -n) + swaps.astype(np.uint64), 3)
    return (np.concatenate((mix(sums[-1:], n), cut, swap)),
            np.repeat(np.array([OWN, CUT, SWAP], np.int8), [1, len(cut), len(swap)]))


def half_keys(norm: Column) -> Column:
    """Keys that two lines within one edit share: split at half of the shorter line's
    length, the part without the edit agrees, as a prefix or as a suffix. A line
    gives its keys for either role, the shorter (or equal) and the longer line."""
    n = F.length(norm)
    def key(side: str, size: Column) -> Column:
        part = F.substring(norm, F.lit(1), size) if side == "p" else F.substring(norm, n - size + 1, size)
        return F.xxhash64(F.lit(side), size, part)
    half, lower = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.array_distinct(F.array(key("p", half), key("p", lower), key("s", n - half), key("s", n - 1 - lower)))


def _normal(line: str) -> str:
    """What ``_lines`` compares, for one line in Python."""
    return line.strip(" ").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _lines(docs: DataFrame, short_lines: bool) -> DataFrame:
    """Eligible lines: place (doc_id, row, line_no), 128-bit hash, half keys (null for lines that only go if equal)."""
    lines = docs.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    norm = lines.select("doc_id", "row", "line_no", ascii_lower(F.trim("line")).alias("norm"))
    near = (F.size(F.split("norm", "\\s+")) >= MIN_WORDS) | (F.length("norm") >= LONG)
    return norm.where(F.col("norm").rlike(r"(?U)\S") if short_lines else near).select(
        "doc_id", "row", "line_no", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("second"), "norm").alias("h2"),
        F.when(near, half_keys(F.col("norm"))).alias("keys"))


def late_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines with an earlier line within MAX_EDITS.

    Lines that share a half key with another line are numbered in order of their first place.
    Of these, only lines that also share a region key with another one emit deletion variants, and only those
    with the deletion in such a region. For each variant's key the
    smallest numbers, combined before the shuffle, tell each of its lines the earliest line
    it meets there; no pairs of a group are formed. The pair of a line
    and its earliest one is then verified by edit distance.
    """
    keys = distinct.select("h1", "h2", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d")).where(
        "a <> b or c <> d").select("key")
    some = keys.join(shared.hint("merge"), "key").select("h1", "h2").distinct()
    numbered = stored(distinct.select("h1", "h2", "first").join(some.hint("merge"), ["h1", "h2"]).orderBy("first")
                      .withColumn("sid", F.monotonically_increasing_id()), "line-some")
    need = numbered.groupBy(F.col("first.doc_id").alias("n_id"), F.col("first.row").alias("n_row")).agg(
        F.collect_list(F.struct("first.line_no", "sid")).alias("need"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, wanted in zip(b["text"], b["need"], strict=True):
                lines = text.split("\n")
                rows += [(w["sid"], _normal(lines[w["line_no"]])) for w in wanted]
            yield pd.DataFrame(rows, columns=["sid", "norm"])

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b["norm"].str.len().cumsum() // EMIT_CHARS):
                keys = [region_keys(norm) for norm in part["norm"]]
                sizes = [len(k) for k in keys]
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "sid": np.repeat(part["sid"].to_numpy(np.int64), sizes),
                                    "region": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b["norm"].str.len().cumsum() // EMIT_CHARS):
                keys, kinds = zip(*map(variant_keys, part["norm"], part["regions"]), strict=True)
                yield pd.DataFrame({"v": np.concatenate(keys).view(np.int64), "kind": np.concatenate(kinds),
                                    "sid": np.repeat(part["sid"].to_numpy(np.int64), [len(k) for k in keys])})

    texts = stored(docs.join(need.hint("merge"), F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("row") == F.col("n_row")))
                   .select("text", "need").mapInPandas(pick, "sid long, norm string").dropDuplicates(["sid"]), "line-texts")
    places = stored(texts.mapInPandas(regions, "key long, sid long, region int"), "line-regions")
    met = places.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("key")
    wanted = places.join(met.hint("merge"), "key").groupBy("sid").agg(F.collect_set("region").alias("regions"))
    variants = stored(texts.join(wanted.hint("merge"), "sid").select("sid", "norm", "regions").mapInPandas(
        emit, "v long, kind byte, sid long"), "line-variants")
    least = variants.groupBy("v").agg(
        F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.min(F.when(F.col("kind") == OWN, F.col("sid"))).alias("own"),
        F.min(F.when(F.col("kind") == CUT, F.col("sid"))).alias("cut")).where("lo < hi")
    other = F.when(F.col("kind") == OWN, F.col("cut")).when(F.col("kind") == CUT, F.col("own")).otherwise(F.col("lo"))
    pairs = variants.join(least.hint("merge"), "v").select("sid", other.alias("other")).where("other < sid").groupBy("sid").agg(
        F.min("other").alias("other"))
    verified = (pairs.join(texts, "sid").join(texts.select(F.col("sid").alias("other"), F.col("norm").alias("earlier")), "other")
                .where(F.levenshtein("norm", "earlier", MAX_EDITS) >= 0).select("sid"))
    return stored(numbered.join(verified, "sid").select("h1", "h2"), "line-late")


def _drop_lines(name: str):
    def rest(text: pd.Series, dropped: pd.Series) -> pd.Series:
        def one(t, d):
            if d is None or not len(d):
                return t
            gone = set(d)
            return "\n".join([x for i, x in enumerate(t.split("\n")) if i not in gone])
        return pd.Series([one(t, d) for t, d in zip(text, dropped, strict=True)], dtype=object)
    rest.__name__ = name
    return F.pandas_udf(rest, "string")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = False,
               counts: tuple[str, str] = ("_dropped", "_lines")) -> DataFrame:
    """Drop repeated lines, keeping the earliest.

    Lines of at least MIN_WORDS words or LONG characters are compared without outer spaces and with A-Z
    lower-cased. A line goes if an earlier line (smaller doc_id, then place) of the table is equal
    or within MAX_EDITS character edits. With ``short_lines``, every other line with a visible character
    goes too if an earlier one is equal. Returns the input's columns with the text
    replaced, and, named by ``counts``, the number of lines gone and of lines. An input column
    of such a name gives way to the count; every other column stays, whatever its name.
    Chains go link by link: a line goes for an earlier near line even if that one goes too.

    A null text stays null; a document whose lines all go has an empty text. A null id
    is the earliest. Rows that agree in id and text are one document and get one
    verdict. An empty table gives an empty result.
    """
    text = ref(text_col).cast("string")
    row = F.xxhash64(text)
    n_dropped, n_lines = counts
    g_id, g_row, g_gone, own_row = unused([*docs.columns, *counts], "_g_id", "_g_row", "_gone", "_row")
    base = docs.select(ref(id_col).alias("doc_id"), row.alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    lines = stored(_lines(base, short_lines), "line-places")
    place = F.struct("doc_id", "row", "line_no")
    distinct = stored(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")),
                      "line-distinct")
    late = late_lines(base, distinct).withColumn("late", F.lit(True))
    marked = (distinct.select("h1", "h2", "first", "n").join(late.hint("merge"), ["h1", "h2"], "left").where("n > 1 or late")
              .select("h1", "h2", "first", F.coalesce("late", F.lit(False)).alias("late")))
    gone = (lines.select("doc_id", "row", "line_no", "h1", "h2").join(stored(marked, "line-marked"), ["h1", "h2"])
            .where(F.col("late") | ~place.eqNullSafe(F.col("first")))
            .groupBy(F.col("doc_id").alias(g_id), F.col("row").alias(g_row)).agg(F.collect_set("line_no").alias(g_gone)))
    gone = stored(gone, "line-gone")
    kept = [c for c in docs.columns if c.lower() not in (n_dropped.lower(), n_lines.lower())]
    joined = docs.select(*map(ref, kept), row.alias(own_row)).join(
        gone.hint("merge"), ref(id_col).eqNullSafe(F.col(g_id)) & (F.col(own_row) == F.col(g_row)), "left")
    out = [(_drop_lines("kept_lines")(text, F.col(g_gone)).alias(c) if c == text_col else ref(c)) for c in kept]
    return joined.select(*out, F.coalesce(F.size(g_gone), F.lit(0)).alias(n_dropped),
                         F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias(n_lines))


def op3_line_dedup(spark, sf_dir) -> DataFrame:
    kept = line_dedup(documents(spark, sf_dir).select("doc_id", "text"), short_lines=True)
    return kept.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
