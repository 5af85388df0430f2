"""PERSON and LOCATION by gazetteer (C1): names joined with the token n-grams of texts.

No language model is involved: a gazetteer is a table ``(entity, phrase, score)``, of any
size.  It is first cut to the names whose tokens all occur in the texts.  Texts emit their token
n-grams up to ``max_tokens`` tokens (a row-local generator), and an equi-join on the phrase finds the
names; which side is broadcast is left to the optimizer, which then knows their size.  A phrase matches with its own spelling and its own single characters between the
tokens.  The spans are then *external spans*: ``pii.detect_spans(external=...)`` puts them
under the entity policy and resolves them with those of the recognizers, longest match
first where scores are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.spans import let, pair_spans, regex_pairs
from veilframe.operators.pii import EXTERNAL_ARRAY, fenced
from veilframe.session import written

TOKEN = "[A-Za-z0-9#]+"
MAX_TOKENS = 4


def _grams(text: Column, max_tokens: int) -> Column:
    """array<struct<span_start, span_end, phrase>>: runs of up to ``max_tokens`` tokens with one
    character between neighbours."""
    def all_runs(toks, data):
        def run(t, i, n):
            last = F.get(toks, i + (n - 1))
            close = F.lit(True)
            for k in range(n - 1):
                close = close & (F.get(toks, i + (k + 1))["span_start"] == F.get(toks, i + k)["span_end"] + 1)
            size = last["byte_start"] + F.octet_length(last["value"]) - t["byte_start"]
            return F.when(last.isNotNull() & close, F.struct(t["span_start"].alias("span_start"), last["span_end"].alias("span_end"),
                                                             F.substring(data, t["byte_start"] + 1, size).cast("string").alias("phrase")))

        def of(n):
            return F.transform(toks, lambda t, i: run(t, i, n))

        runs = F.flatten(F.array(*[of(n) for n in range(1, max_tokens + 1)]))
        return F.filter(runs, lambda r: r.isNotNull())

    return let(text.cast("binary"), lambda data: let(pair_spans(regex_pairs(text, TOKEN)), lambda toks: all_runs(toks, data)))


def _live(names: DataFrame, texts: DataFrame) -> DataFrame:
    """The names whose every token is a token of some text, written: no other one can occur.  The
    distinct tokens of the texts are combined before they are shuffled, so neither side moves its
    n-grams, and what is left has a known size when the join with them is planned."""
    tokens = F.array_distinct(F.regexp_extract_all("phrase", F.lit(TOKEN), F.lit(0)))
    asked = names.withColumn("_tokens", tokens).select(*names.columns, F.size("_tokens").alias("_n"), F.explode("_tokens").alias("_token"))
    held = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0)))).alias("_token")).distinct()
    live = asked.join(held, "_token", "left_semi").groupBy(*names.columns, "_n").agg(F.count(F.lit(1)).alias("_held")).where("_held = _n")
    return written(live.select(*names.columns), "live-names")


def named_spans(df: DataFrame, gazetteer: DataFrame, id_col: str, text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(id, span_start, span_end, entity, score, value) of every gazetteer phrase in the texts.

    Phrases of more than ``max_tokens`` tokens are not found; repeated phrases of one entity count
    once, with their largest score; null texts and phrases match nothing."""
    names = gazetteer.where("phrase is not null").groupBy("entity", "phrase").agg(F.max(F.col("score").cast("double")).alias("score"))
    texts = df.select(id_col, F.col(text_col).cast("string").alias("_text"))
    live = _live(names, texts)
    grams = fenced(texts, "_grams", _grams(F.col("_text"), max_tokens))
    rows = grams.select(id_col, F.explode("_grams").alias("g")).select(id_col, "g.*")
    return rows.join(live, "phrase").select(id_col, "span_start", "span_end", "entity", "score", F.col("phrase").alias("value"))


def with_named_spans(df: DataFrame, gazetteer: DataFrame, id_col: str, text_col: str = "text", out: str = "external", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``df`` with a column of external spans per row, empty where no name occurs; rows are told
    apart by ``id_col``."""
    found = named_spans(df, gazetteer, id_col, text_col, max_tokens)
    spans = found.groupBy(F.col(id_col).alias("_gid")).agg(F.collect_set(F.struct("span_start", "span_end", "entity", "score")).alias("_spans"))
    joined = df.join(spans, F.col(id_col).eqNullSafe(F.col("_gid")), "left")
    return joined.select(*df.columns, F.coalesce("_spans", F.array()).cast(EXTERNAL_ARRAY).alias(out))
