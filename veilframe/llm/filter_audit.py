"""Filter interaction audit: mask cells folded over all orders of five filters (SQL functions only)."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import UPPER, documents
from veilframe.sources.tables import load

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
# the order array that every cell folds over: 120 arrays of filter bits, a constant of the plan
ORDER_BITS = "array(" + ", ".join("array(" + ", ".join(str(1 << FILTERS.index(f)) for f in o) + ")" for o in ORDERS) + ")"
STEP = "struct<bit:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def failing_bits(words: Column, text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    checks = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]")]
    bits = F.lit(0)
    for i, check in enumerate(checks):
        bits = bits + F.when(check, 1 << i).otherwise(0)
    return bits


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Cells (part, mask, n, good, toxic): documents by the set of filters they fail.

    Equal texts are found by their SHA-256. Every grouping holds back rows that agree in
    all its keys before the shuffle, and the smallest id of a text is taken over at most one
    row for each part, so a group of copies never meets in one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = rows.withColumn("words", F.array_remove(F.split("text", SPACE, -1), ""))
    flagged = split.select("id", "part", failing_bits(F.col("words"), F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("sha"))
    # rows without an id find no label: a salt of their own spreads them in the join
    salt = F.when(F.col("id").isNull(), F.xxhash64("sha", "part") % 4096).otherwise(0)
    keyed = flagged.groupBy("sha", "part", "mask", "id").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", salt)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = keyed.join(marks.withColumn("label_salt", F.lit(0).cast("long")), (F.col("id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left")
    sized = marked.select("sha", "part", "mask", "id", F.struct(
        "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")).alias("w"))
    sums = lambda what: F.struct(*[F.coalesce(F.sum(F.when(what, F.col("w")[c])), F.lit(0).cast("long")).alias(c) for c in ("n", "good", "toxic")])
    texts = sized.groupBy("sha", "part", "mask").agg(
        sums(F.lit(True)).alias("all"), sums(F.col("id").isNull()).alias("unnamed"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "w"))).alias("first"))
    least = texts.withColumn("least", F.min("first.id").over(Window.partitionBy("sha")))
    leads = F.coalesce(F.col("first.id") == F.col("least"), F.lit(False))
    passing = F.struct(*[(F.col("unnamed")[c] + F.when(leads, F.col("first.w")[c]).otherwise(0)).alias(c) for c in ("n", "good", "toxic")])
    both = least.withColumn("pass", passing).select("part", F.explode(F.array(
        F.struct("mask", *[F.col("pass")[c].alias(c) for c in ("n", "good", "toxic")]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col("all")[c] - F.col("pass")[c]).alias(c) for c in ("n", "good", "toxic")]))).alias("c"))
    return both.where("c.n > 0").groupBy("part", "c.mask").agg(*[F.sum(F.col("c")[c]).alias(c) for c in ("n", "good", "toxic")])


def fold_cell() -> Column:
    """The 600 structs of a cell (mask, n, good, toxic): per order, a fold over its five filters."""
    step = f"""cast(struct(f as bit,
        if((acc.seen | f) & mask = 0, n, 0), if(acc.seen & mask = 0 and f & mask != 0, n, 0),
        if(acc.seen & mask != 0 and f & mask != 0, n, 0), if(mask = f, n, 0),
        if(acc.seen & mask = 0 and f & mask != 0, good, 0), if(acc.seen & mask = 0 and f & mask != 0, toxic, 0)) as {STEP})"""
    return F.expr(f"""flatten(transform({ORDER_BITS}, bits -> aggregate(bits,
        struct(0 as seen, cast(array() as array<{STEP}>) as steps),
        (acc, f) -> struct(acc.seen | f as seen, concat(acc.steps, array({step})) as steps),
        acc -> acc.steps)))""")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """How five filters interact, by part, order and step (600 rows a part).

    Filters: A under 100 words; B under 80 % distinct words; C over 10 % capitals A-Z;
    D any of ``#$%&*|``; E the text of a row with a smaller id, removed or not.

    A null text is empty, a null part is the part ''. A row without an id never fails E and has no
    label; rows that repeat id and text count one by one, all failing E or none. A document is good
    or toxic if any of its label rows says so. An empty table gives no rows. Only the named columns
    (and doc_id, quality, toxic of the labels) are read.
    """
    folded = mask_cells(docs, labels, id_col, text_col, part_col).withColumn("steps", fold_cell())
    # at most 32 cells a part, each of 600 structs
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).withColumn("steps", F.expr(
        "aggregate(slice(cells, 2, size(cells)), cells[0], (acc, cell) -> zip_with(acc, cell, (a, b) -> struct(a.bit as bit, "
        + ", ".join(f"a.{c} + b.{c} as {c}" for c in COUNTS) + ")))"))
    shares = merged.withColumn("shares", F.expr(
        "transform(sequence(0, 4), k -> aggregate(steps, 0L, (total, s) -> total + if(s.bit = shiftleft(1, k), s.removed, 0L)))"))
    names = F.expr("array(" + ", ".join(f"'{o}'" for o in ORDERS) + ")")
    rows = shares.select("part", "shares", F.posexplode("steps").alias("at", "s"))
    return rows.select("part", F.get(names, F.floor(F.col("at") / 5).cast("int")).alias("filter_order"), (F.col("at") % 5 + 1).cast("int").alias("step"),
                       *[F.col("s")[c].alias(c) for c in COUNTS], F.get("shares", F.log2(F.col("s.bit")).cast("int")).alias("shapley"))


def op13_filter_audit(spark, sf_dir) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), load(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws FROM t),
f AS (SELECT part, doc_id, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
             100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, map(['A', 'B', 'C', 'D', 'E'], [fails.A, fails.B, fails.C, fails.D, fails.E]) AS fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT p.k || q.k || r.k || s.k || u.k AS filter_order FROM k p, k q, k r, k s, k u
      WHERE len(list_distinct([p.k, q.k, r.k, s.k, u.k])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS k, string_split(filter_order[:step - 1], '') AS before
      FROM o, range(1, 6) r(step)),
z AS (SELECT part, filter_order, step::INT AS step, k, n, good, toxic, fails[k] AS fail,
             len(list_filter(before, lambda v: coalesce(fails[v], false))) > 0 AS gone,
             len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda v: fails[v])) = 1 AS alone
      FROM cells, s),
g AS (SELECT part, filter_order, step, k, sum(n) FILTER (NOT gone AND NOT fail) AS kept, sum(n) FILTER (NOT gone AND fail) AS removed,
             sum(n) FILTER (gone AND fail) AS redundant, sum(n) FILTER (fail AND alone) AS unique_fails,
             sum(n * good) FILTER (NOT gone AND fail) AS good_lost, sum(n * toxic) FILTER (NOT gone AND fail) AS toxic_lost
      FROM z GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT AS shapley
FROM g
"""
