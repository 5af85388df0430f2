"""DuckDB formulation of detection / scrub / restore, used as the oracle.

Written independently of the Spark expressions: offsets via list sums,
greedy overlap resolution via ``list_reduce``, placeholder numbering via
window functions and text rebuild via ``string_agg``.
"""

from __future__ import annotations

from veilframe.operators.recognizers import (
    CONTEXT_BOOST,
    CONTEXT_FLOOR,
    CONTEXT_TOKENS,
    DEFAULT_RECOGNIZERS,
    PLACEHOLDER_REGEX,
    SCORE_THRESHOLD,
    EntityPolicy,
    Recognizer,
    select_recognizers,
)
from veilframe.plans.registry import sql_str


def _luhn_sql(v: str) -> str:
    d = f"reverse(regexp_replace({v}, '[^0-9]', '', 'g'))"
    digit = "coalesce(try_cast(c AS INTEGER), 0)"
    return (f"(list_sum(list_transform(string_split({d}, ''), lambda c, i: CASE WHEN i % 2 = 1 THEN {digit} "
            f"WHEN 2 * {digit} > 9 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)")


def _mod97_sql(v: str) -> str:
    x = f"upper(regexp_replace({v}, '[^A-Za-z0-9]', '', 'g'))"
    r = f"(substr({x}, 5) || substr({x}, 1, 4))"
    return (f"(list_reduce(list_filter(string_split({r}, ''), lambda c: c <> ''), lambda acc, c: "
            f"CASE WHEN ascii(c) BETWEEN 48 AND 57 THEN (acc * 10 + ascii(c) - 48) % 97 "
            f"ELSE (acc * 100 + ascii(c) - 55) % 97 END, 0::BIGINT) = 1)")


def _raw_cte(i: int, rec: Recognizer) -> str:
    p = sql_str(rec.regex)
    conds = [f"regexp_matches(v, {sql_str(q)})" for q in rec.requires]
    if rec.checksum == "luhn":
        conds.append(_luhn_sql("v"))
    elif rec.checksum == "mod97":
        conds.append(_mod97_sql("v"))
    where = " AND ".join(conds) if conds else "TRUE"
    if rec.context:
        toks = "regexp_extract_all(substr(text, 1, s), '[A-Za-z0-9_]+')"
        last = f"list_transform({toks}[greatest(len({toks}) - {CONTEXT_TOKENS - 1}, 1):], lambda t: lower(t))"
        near = " OR ".join(f"contains(t, {sql_str(w)})" for w in rec.context)
        score = (f"CASE WHEN len(list_filter({last}, lambda t: {near})) > 0 THEN "
                 f"least(1.0::DOUBLE, greatest({rec.score}::DOUBLE + {CONTEXT_BOOST}::DOUBLE, {CONTEXT_FLOOR}::DOUBLE)) "
                 f"ELSE {rec.score}::DOUBLE END")
    else:
        score = f"{rec.score}::DOUBLE"
    return f"""raw_{i} AS (
  SELECT rid, text, {sql_str(rec.entity)} AS entity, m.s AS s, m.s + length(m.v) AS e, m.v AS v
  FROM (
    SELECT rid, text, unnest(list_transform(ms, lambda x, j: {{
        'v': x,
        's': (coalesce(list_sum(list_transform(gaps[1:j], lambda g: length(g))), 0)
           + coalesce(list_sum(list_transform(ms[1:j - 1], lambda q: length(q))), 0))::BIGINT}})) AS m
    FROM (SELECT rid, text, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gaps
          FROM src WHERE text IS NOT NULL)
  )
), cand_{i} AS (
  SELECT rid, entity, s, e, v, {score} AS score FROM raw_{i} WHERE {where}
)"""


def scrub_ctes(source_sql: str, recognizers=DEFAULT_RECOGNIZERS, policy: EntityPolicy | None = None,
               mode: str = "reversible", threshold: float = SCORE_THRESHOLD) -> str:
    """CTE chain over ``src(rid, text)`` defining

    * ``cand(rid, entity, s, e, v, score)`` candidate spans,
    * ``kept(...)`` after overlap resolution,
    * ``ph(..., placeholder)`` with placeholder numbering,
    * ``scrubbed(rid, text, scrubbed_text, n_entities)`` one row per source row.
    """
    recs = select_recognizers(tuple(recognizers), policy or EntityPolicy())
    parts = [f"src AS ({source_sql})"]
    parts += [_raw_cte(i, r) for i, r in enumerate(recs)]
    union = "\n  UNION ALL ".join(f"SELECT * FROM cand_{i}" for i in range(len(recs)))
    parts.append(f"cand AS (SELECT * FROM ({union}) WHERE score >= {threshold})")
    parts.append("""grouped AS (
  SELECT rid, list_sort(list({'k1': -score, 'k2': s - e, 'k3': s, 'k4': entity,
                               's': s, 'e': e, 'entity': entity, 'score': score, 'v': v})) AS ordered
  FROM cand GROUP BY rid
)""")
    parts.append("""kept AS (
  SELECT rid, k.entity AS entity, k.s AS s, k.e AS e, k.v AS v, k.score AS score
  FROM (SELECT rid, unnest(list_reduce(ordered, lambda acc, x:
          CASE WHEN len(list_filter(acc, lambda c: NOT (x.e <= c.s OR x.s >= c.e))) > 0 THEN acc
               ELSE list_append(acc, x) END, ordered[1:0])) AS k
        FROM grouped)
)""")
    if mode == "reversible":
        idx = "row_number() OVER (PARTITION BY rid, entity ORDER BY s)"
        parts.append(f"ph AS (SELECT *, '<' || entity || '_' || CAST({idx} AS VARCHAR) || '>' AS placeholder FROM kept)")
    else:
        parts.append("""ph AS (
  SELECT rid, entity, s, e, v, score,
         '<' || entity || '_' || CAST(dense_rank() OVER (PARTITION BY rid, entity ORDER BY first_s) AS VARCHAR) || '>' AS placeholder
  FROM (SELECT *, min(s) OVER (PARTITION BY rid, entity, v) AS first_s FROM kept)
)""")
    parts.append("""pieces AS (
  SELECT ph.rid, ph.s, ph.e, ph.placeholder,
         substr(src.text, coalesce(lag(ph.e) OVER (PARTITION BY ph.rid ORDER BY ph.s), 0) + 1,
                ph.s - coalesce(lag(ph.e) OVER (PARTITION BY ph.rid ORDER BY ph.s), 0)) AS gap
  FROM ph JOIN src USING (rid)
)""")
    parts.append("""rebuilt AS (
  SELECT rid, string_agg(gap || placeholder, '' ORDER BY s) AS body, max(e) AS last_e, count(*) AS n
  FROM pieces GROUP BY rid
)""")
    parts.append("""scrubbed AS (
  SELECT src.rid, src.text,
         CASE WHEN src.text IS NULL THEN NULL
              WHEN r.rid IS NULL THEN src.text
              ELSE r.body || substr(src.text, r.last_e + 1) END AS scrubbed_text,
         coalesce(r.n, 0)::BIGINT AS n_entities
  FROM src LEFT JOIN rebuilt r USING (rid)
)""")
    return "WITH " + ",\n".join(parts)


def restore_sql(text: str, mapping: str) -> str:
    """DuckDB expression: single-pass placeholder replacement using a MAP."""
    p = sql_str(PLACEHOLDER_REGEX)
    ms = f"regexp_extract_all({text}, {p})"
    gaps = f"string_split_regex({text}, {p})"
    return (f"CASE WHEN {text} IS NULL THEN NULL ELSE array_to_string(list_transform({gaps}, lambda g, j: g || "
            f"coalesce(CASE WHEN j <= len({ms}) THEN coalesce({mapping}[{ms}[j]], {ms}[j]) END, '')), '') END")


def mapping_string_sql(rid_expr: str = "rid") -> str:
    """Aggregate over ``ph`` rows: sorted ``placeholder=value`` joined by \\x01."""
    return "string_agg(placeholder || '=' || v, chr(1) ORDER BY placeholder || '=' || v)"
