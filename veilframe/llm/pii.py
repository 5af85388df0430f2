"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides (DataFrame operations only)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import documents, ref, stored, unused

# Base kinds in their order: fixed patterns. Possessive runs and look-behinds keep each
# linear in the text without changing its matches; groups repeat one character at
# a time so that long runs need no recursion.
WORD = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{WORD})){WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?=[0-9]|[ -][0-9])[0-9 -])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What the method adds, if the classifier accepts it.
EXTRA = {
    "account": r"(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9+)( -])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": r"(?<=(?:key|oken|cret|word) ?[=:] ?\"?)[A-Za-z0-9_-]{16,128}(?![A-Za-z0-9_-])",
    "written_email": r"(?<![A-Za-z0-9])[A-Za-z0-9._]{2,40} ?[(\[]at[)\]] ?[A-Za-z0-9-]{2,40} ?[(\[]dot[)\]] ?[a-z]{2,6}(?![a-z])",
}
KINDS = [*BASE, *EXTRA]
CONTEXT = 40  # characters before a match that the context labeler reads

# Gazetteers and cue words of the labelers.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "nl", "info"]
CUES = {
    "email": "mail|contact|write|reach", "ip": r"\bip\b|address|host|server|login", "card": "card|visa|credit|pay",
    "phone": "phone|tel|call|mobile|fax|dial", "account": "account|iban|bank|customer|konto|cuenta|compte", "local_phone": "phone|tel|call|mobile|fax|dial",
    "secret": "key|token|secret|password", "written_email": "mail|contact|write|reach",
}
LABELERS = ("shape", "gazetteer", "context", "noise")
SMOOTH, ROUNDS = 1.0, 40


def _all_matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, nth, gap, match, before): all matches of a text in order."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("gap"))
    found = F.transform(F.filter(zipped, lambda z: z["match"].isNotNull()), lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("nth"), F.length(z["gap"]).alias("gap"), z["match"].alias("match"),
        F.lower(F.right(z["gap"], F.lit(CONTEXT))).alias("before")))
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,match:string,before:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _kind_case(by_kind: dict[str, Column], default: Column) -> Column:
    return reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), by_kind.items(), F.when(F.lit(False), default)).otherwise(default)


def candidates(docs: DataFrame) -> DataFrame:
    """Stored candidate spans of rows (doc_id, row, text): doc_id, row, kind, start, end, match,
    before, base; a row without any match appears once with a null kind.

    Starts are running sums of gaps and matches, so a text of many matches costs n log n.
    """
    arrays = [_all_matches(F.col("text"), k, p) for k, p in (BASE | EXTRA).items()]
    found = docs.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "row", F.explode_outer(F.concat(*arrays)).alias("m"))
    rows = found.select("rid", "doc_id", "row", "m.*").repartition("rid")
    # what lies before a match: all gaps up to it and all earlier matches
    order = Window.partitionBy("rid", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("match")).over(order).cast("long")
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).withColumn("digits", _digits(F.col("match")))
    n = F.length("digits")
    card = (n >= 13) & (n <= 19) & _luhn(F.when(n <= 19, F.col("digits")).otherwise(F.lit("0")))
    parts = F.forall(F.split("match", "[.]"), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.regexp_replace(p, "^0+", "").cast("int").isNull() | (F.regexp_replace(p, "^0+", "").cast("int") <= 255)))
    base = _kind_case({"email": F.lit(True), "ip": parts, "card": card, "phone": (n >= 9) & (n <= 15)}, F.lit(False))
    keep = F.col("kind").isNull() | base | F.col("kind").isin(*EXTRA)
    # a row whose matches all failed still has to appear
    first = F.row_number().over(Window.partitionBy("rid").orderBy("kind", "nth")) == 1
    checked = placed.withColumn("keep", keep).withColumn("base", base).withColumn("first", first)
    return stored(checked.where("keep or first").select("rid", "doc_id", "row", F.when(F.col("keep"), F.col("kind")).alias("kind"), "start", "end", "match", "before", "digits", "base"), "pii-candidates")


def votes(found: DataFrame) -> DataFrame:
    """Each labeler's vote (1, 0 or -1) and the shape features of the candidates."""
    n, d, m = F.length("match"), F.col("digits"), F.col("match")
    vote = lambda yes, no=None: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)
    domain = F.regexp_extract(m, r"\.?([A-Za-z]+)$", 1)
    both = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    shape = _kind_case({
        "email": vote(domain.rlike("^[a-zA-Z]{2,8}$"), domain == ""), "ip": vote(~m.rlike(r"(^|\.)0[0-9]")), "card": vote(F.lit(True)),
        "phone": vote(F.length(d) >= 10), "account": vote(F.lit(False), F.length(d) > 16), "local_phone": vote(~d.rlike("^[01]")),
        "secret": vote(both & (n >= 20), ~both), "written_email": vote(F.lit(True))}, F.lit(0))
    gazetteer = _kind_case({
        "email": vote(F.lower(domain).isin(*TOP_DOMAINS)), "ip": vote(F.lit(False), m.rlike(r"^(0|127|22[4-9]|2[345][0-9])\.")),
        "card": vote(d.rlike("^[3-6]"), d.rlike("^0")), "phone": vote(m.rlike(r"^\+(1|33|34|44|49)[ (]")), "account": vote(F.lit(False), d.rlike("^0")),
        "secret": vote(F.col("before").rlike("(api|access|auth|token|secret|key|password)[_a-z]* ?[=:] ?\"?$")),
        "written_email": vote(F.lower(domain).isin(*TOP_DOMAINS))}, F.lit(0))
    context = F.when(F.col("kind").isNull(), 0).otherwise(_kind_case({k: vote(F.col("before").rlike(c)) for k, c in CUES.items()}, F.lit(0)))
    noise = F.when(d.rlike(r"^(.)\1*$") & (F.length(d) > 3) | F.col("before").rlike(r"[0-9a-z_]$") & (F.col("kind") != "secret"), -1).otherwise(0)
    size = F.least(F.floor(F.log2(n)), F.lit(6)).cast("int")
    return found.withColumns({"shape": shape, "gazetteer": gazetteer, "context": context, "noise": noise, "size": size})


def estimate(patterns: list[tuple]) -> dict[tuple, float]:
    """EM over vote patterns (kind, votes..., count): labeler reliabilities as vote
    probabilities given the truth, and a prior for each kind; returns each pattern's
    probability of being personal data."""
    start = {p[:-1]: min(0.95, max(0.05, 0.5 + 0.2 * sum(p[1:-1]))) for p in patterns}
    prob = start
    for _ in range(ROUNDS):
        weight = [[{v: SMOOTH for v in (-1, 0, 1)} for _ in LABELERS] for _ in (0, 1)]
        prior = {k: [1.0, 1.0] for k in KINDS}
        for p in patterns:
            for y in (0, 1):
                share = p[-1] * (prob[p[:-1]] if y else 1 - prob[p[:-1]])
                prior[p[0]][y] += share
                for j, v in enumerate(p[1:-1]):
                    weight[y][j][v] += share
        new = {}
        for p in patterns:
            odds = [math.log(prior[p[0]][y] / sum(prior[p[0]])) + sum(math.log(weight[y][j][v] / sum(weight[y][j].values())) for j, v in enumerate(p[1:-1])) for y in (0, 1)]
            new[p[:-1]] = 1 / (1 + math.exp(max(-50, min(50, odds[0] - odds[1]))))
        prob = new
    # the labels are named by the votes: personal data is the class with the better votes
    mean = lambda y: sum(sum(p[1:-1]) * p[-1] * (prob[p[:-1]] if y else 1 - prob[p[:-1]]) for p in patterns) / max(1e-9, sum(p[-1] * (prob[p[:-1]] if y else 1 - prob[p[:-1]]) for p in patterns))
    return prob if mean(1) >= mean(0) else {k: 1 - v for k, v in prob.items()}


def train_classifier(rows: list[tuple]) -> dict[str, float]:
    """Logistic regression on (kind, votes..., size, posterior, count) rows; weights by feature."""
    names = lambda r: ["bias", f"kind={r[0]}", *[f"{lab}={v}" for lab, v in zip(LABELERS, r[1:5], strict=True)], f"size={r[5]}"]
    weights: dict[str, float] = {}
    total = sum(r[-1] for r in rows) or 1
    for _ in range(300):
        slope: dict[str, float] = {}
        for r in rows:
            z = sum(weights.get(f, 0.0) for f in names(r))
            miss = (r[-2] - 1 / (1 + math.exp(-max(-50, min(50, z))))) * r[-1] / total
            for f in names(r):
                slope[f] = slope.get(f, 0.0) + miss
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) + 2.0 * (g - 1e-4 * weights.get(f, 0.0))
    return weights


def find_spans(docs: DataFrame) -> DataFrame:
    """Stored accepted spans of rows (doc_id, row, text): candidates of a base kind and those
    the classifier accepts; a row without spans appears once with a null kind.

    Labeler votes are summed up by pattern: kinds x 3^4 patterns x 7 sizes bound what
    reaches the driver, whatever the corpus.
    """
    voted = votes(candidates(docs))
    table = [tuple(r) for r in voted.where("kind is not null").groupBy("kind", *LABELERS, "size").agg(F.count(F.lit(1))).collect()]
    merged: dict[tuple, int] = {}
    for r in table:
        merged[r[:5]] = merged.get(r[:5], 0) + r[-1]
    prob = estimate([(*k, n) for k, n in sorted(merged.items())])
    weights = train_classifier([(*r[:6], prob[r[:5]], r[6]) for r in sorted(table)])
    weigh = lambda name, column: reduce(lambda c, kv: c + F.when(column == kv[0], kv[1]).otherwise(0.0),
                                        [(f.split("=", 1)[1], w) for f, w in sorted(weights.items()) if f.startswith(name + "=")], F.lit(0.0))
    z = F.lit(weights.get("bias", 0.0)) + weigh("kind", F.col("kind"))
    for lab in (*LABELERS, "size"):
        z = z + weigh(lab, F.col(lab).cast("string"))
    return voted.withColumn("accepted", F.col("base") | (z >= 0)).select(
        "rid", "doc_id", "row", F.when(F.col("accepted"), F.col("kind")).alias("kind"), "start", "end", "base")


def _written(only_base: bool) -> Column:
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    wanted = F.col("kind").isNotNull() & (F.col("base") if only_base else F.lit(True))
    spans = F.sort_array(F.collect_list(F.when(wanted, F.struct(order.alias("o"), "start", "end", "kind"))))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ref(text_col).cast("string")
    return docs.select(ref(id_col).alias("doc_id"), F.xxhash64(text).alias("row"), F.coalesce(text, F.lit("")).alias("text"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, base_sha256, spans.

    Null texts count as empty and have no spans; repeated rows and null ids give a row
    each; an empty table gives an empty result; only the two named columns are read.
    """
    found = find_spans(_rows(docs, id_col, text_col))
    count = lambda k: F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}")
    return found.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(_written(True), 256).alias("base_sha256"),
                                    _written(False).alias("spans")).drop("rid")


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with every span replaced by its kind in angle brackets; overlapping spans are
    replaced as one, by the kind that starts first. Null texts stay null, rows that repeat are
    masked alike, null ids keep their row, an empty table gives an empty result, and other columns
    stay as they are, whatever their names."""
    p_id, p_row, p_spans = unused(docs.columns, "_p_id", "_p_row", "_p_spans")
    spans = find_spans(_rows(docs, id_col, text_col)).where("kind is not null").select("doc_id", "row", "kind", "start", "end").distinct()
    order = Window.partitionBy("doc_id", "row").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    isle = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("isle", F.sum("new").over(order))
    merged = isle.groupBy("doc_id", "row", "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    lists = merged.groupBy(F.col("doc_id").alias(p_id), F.col("row").alias(p_row)).agg(
        F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"), "kind"))).alias(p_spans))
    text, at = ref(text_col).cast("string"), F.col(p_spans)
    pieces = F.transform(at, lambda x, i: F.concat(
        F.substring(text, F.when(i == 0, 1).otherwise(F.get(at, i - 1)["e"] + 1), x["s"] - F.when(i == 0, 0).otherwise(F.get(at, i - 1)["e"])),
        F.lit("<"), x["kind"], F.lit(">")))
    last = F.element_at(at, -1)["e"]
    masked = F.when(at.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text))))
    joined = docs.join(stored(lists, "pii-lists").hint("merge"), ref(id_col).eqNullSafe(F.col(p_id)) & (F.xxhash64(text) == F.col(p_row)), "left")
    return joined.select(*[masked.alias(c) if c == text_col else ref(c) for c in docs.columns])


def op7_pii(spark, sf_dir) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
