"""Unit cases for prompt, cache, token, sealing and key helpers."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import cache as C
from veilframe.operators import prompt as P
from veilframe.operators import sealing as S
from veilframe.operators.audit import approx_tokens


def test_approx_tokens(spark):
    df = spark.createDataFrame([("x" * 40,), ("",), ("abc",)], "t string")
    assert [r[0] for r in df.select(approx_tokens(F.col("t"))).collect()] == [10, 0, 1]


def test_vector_quantize(spark):
    df = spark.createDataFrame([([2.0, -7.125, 0.98765432123, 1e-9],)], "v array<double>")
    assert df.select(C.quantize(F.col("v"))).collect()[0][0] == [2.0, -7.125, 0.9876543, 0.0]


@pytest.mark.parametrize("path,provider,upstream", [
    ("/openai/v1/embeddings", "openai", "/v1/embeddings"),
    ("/anthropic/a/b/c", "anthropic", "/a/b/c"),
    ("/gemini/", "gemini", "/"),
    ("/geminis/x", None, None),
    ("openai/v1", None, None),
])
def test_routes(spark, path, provider, upstream):
    r = P.with_route(spark.createDataFrame([(path,)], "path string")).collect()[0]
    assert (r["provider"], r["upstream_path"]) == (provider, upstream)
    assert (r["route_error"] is None) == (provider is not None)


def test_header_filter(spark):
    df = spark.sql("SELECT map('Authorization', 'first', 'Accept', 'text/plain', 'anthropic-BETA', 'b7', 'authorization', 'second',"
                   " 'Content-Type', 'text/csv', 'X-Api-Key', NULL) AS h UNION ALL SELECT map()")
    rows = [r[0] for r in df.select(P.filter_attributes(F.col("h"))).collect()]
    forced = {"content-type": "application/json"}
    assert sorted(rows, key=len) == [forced, {"authorization": "second", "anthropic-beta": "b7", **forced}]


def test_csv_split(spark):
    df = spark.createDataFrame([(" a, b ,,c ",), ("",)], "s string")
    assert [r[0] for r in df.select(P.split_csv(F.col("s"))).collect()] == [["a", "b", "c"], []]


def test_gemini_model_from_path(spark):
    rows = [("gemini", "/v1beta/models/gemini-1.5-pro:generateContent", "{}"),
            ("gemini", "/v1beta/models/gemini-1.5-flash", "{}"),
            ("openai", "/v1/chat/completions", '{"model": "gpt-4o"}'),
            ("openai", "/v1/chat/completions", "{}")]
    df = spark.createDataFrame(rows, "provider string, upstream_path string, b string").withColumn("v", F.parse_json("b"))
    out = [r["model"] for r in P.with_model(df).collect()]
    assert out == ["gemini-1.5-pro", "gemini-1.5-flash", "gpt-4o", None]


def test_prompt_text_dialects(spark):
    rows = [("openai", '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":[{"type":"text","text":"yo"}]}]}'),
            ("anthropic", '{"system":"be nice","messages":[{"role":"user","content":"hello"}]}'),
            ("gemini", '{"contents":[{"role":"user","parts":[{"text":"q"}]}],"systemInstruction":{"parts":[{"text":"s"}]}}')]
    df = spark.createDataFrame(rows, "p string, b string").withColumn("v", F.parse_json("b"))
    out = [r[0] for r in df.select(P.prompt_text(F.col("v"), F.col("p"))).collect()]
    assert out == ["user: hi\nassistant: yo", "system: be nice\nuser: hello",
                   'user: q\nsystem: {"parts":[{"text":"s"}]}']


def test_crypto_roundtrip_and_aad(spark):
    df = spark.createDataFrame([("secret",), ("secret",)], "t string").withColumn(
        "k", F.unhex(F.sha2(F.lit("k"), 256)))
    sealed = df.withColumn("c", S.seal(F.col("t"), F.col("k"), S.AAD_PROMPT, S.random_iv(F.col("t"))))
    rows = sealed.select("c", S.unseal(F.col("c"), F.col("k"), S.AAD_PROMPT).alias("ok"),
                         S.unseal(F.col("c"), F.col("k"), S.AAD_RESPONSE).alias("bad")).collect()
    assert all(r["ok"] == b"secret" and r["bad"] is None for r in rows)
    assert len(rows[0]["c"]) == 12 + 6 + 16
    assert rows[0]["c"][:12] != rows[1]["c"][:12]  # independent nonces


def _request(spark, body):
    df = spark.createDataFrame([(1, "openai", body)], "rid long, provider string, b string").withColumn(
        "v", F.parse_json("b"))
    return P.explode_prompt_parts(df, "rid", "v", "provider")


def test_request_scoped_placeholders_fix_overwrite(spark):
    body = ('{"messages":[{"role":"user","content":"mail a@x.com"},'
            '{"role":"user","content":[{"type":"text","text":"and b@y.org"}]}]}')
    r = P.scrub_requests(_request(spark, body), "rid").collect()[0]
    texts = [p["text"] for p in r["parts"]]
    assert texts == ["mail <EMAIL_ADDRESS_1>", "and <EMAIL_ADDRESS_2>"]
    assert r["mapping"] == {"<EMAIL_ADDRESS_1>": "a@x.com", "<EMAIL_ADDRESS_2>": "b@y.org"}


def test_one_way_request_scope_reuses_values(spark):
    body = ('{"messages":[{"role":"user","content":"a@x.com"},{"role":"user","content":"b@y.org a@x.com"}]}')
    r = P.scrub_requests(_request(spark, body), "rid", mode="one_way").collect()[0]
    assert [p["text"] for p in r["parts"]] == ["<EMAIL_ADDRESS_1>", "<EMAIL_ADDRESS_2> <EMAIL_ADDRESS_1>"]
    assert r["mapping"] == {}


def test_fail_policy_open_and_closed(spark):
    from veilframe.operators import pii

    df = spark.createDataFrame([(1, None), (2, "x" * 3_000_000), (3, "")], "id long, text string")
    keep, rej = pii.fail_policy(df, "text", "closed")
    assert sorted(r["id"] for r in keep.collect()) == [2, 3]  # a long text is a healthy text
    assert [(r["id"], r["error_code"]) for r in rej.collect()] == [(1, "PII_SCRUBBER_UNAVAILABLE")]
    passed, none = pii.fail_policy(df, "text", "open")
    assert none.count() == 0
    assert {r["id"]: r["scrub_passthrough"] for r in passed.collect()} == {1: True, 2: False, 3: False}


def test_level_filter_unknown_is_info(spark):
    from veilframe.operators import metrics as M

    logs = spark.createDataFrame([(1, "debug"), (2, "verbose"), (3, "ERROR"), (4, "info")], "id long, level string")
    assert sorted(r["id"] for r in M.filter_level(logs, "INFO").collect()) == [2, 3, 4]
    assert sorted(r["id"] for r in M.filter_level(logs, "nonsense").collect()) == [2, 3, 4]
    assert sorted(r["id"] for r in M.filter_level(logs, "warning").collect()) == [3]


def test_response_text_of_list_content(spark):
    body = ('{"choices":[{"message":{"content":[{"type":"text","text":"one"},{"type":"image_url"},{"type":"text","text":"two"}]}},'
            '{"message":{"content":null}},{"message":{"content":"three"}}]}')
    df = spark.createDataFrame([("openai", body)], "p string, b string").withColumn("v", F.parse_json("b"))
    assert df.select(P.response_text(F.col("v"), F.col("p"))).collect()[0][0] == "one\ntwo\nthree"


def test_stage_latency_skips_unobserved(spark):
    from veilframe.operators import metrics as M

    df = spark.createDataFrame([(1.0, None), (2.0, 0.5)], "a double, b double")
    got = {r["stage"]: (r["n"], r["seconds_sum"]) for r in M.stage_latency(df, {"first": "a", "second": "b"}).collect()}
    assert got == {"first": (2, 3.0), "second": (1, 0.5)}


def test_payload_versions_round_trip(spark):
    df = spark.createDataFrame([("text",)], "t string").withColumn("k", F.unhex(F.sha2(F.lit("k"), 256)))
    sealed = df.withColumn("c", S.seal(F.col("t"), F.col("k"), S.AAD_PROMPT, S.random_iv(F.col("t"))))
    down = S.evolve_payloads(sealed, 1)
    assert down.columns[-1] == "nonce"
    again = S.evolve_payloads(down, 2)
    assert "nonce" not in again.columns
    assert again.select(S.unseal(F.col("c"), F.col("k"), S.AAD_PROMPT)).collect()[0][0] == b"text"


def test_sealed_tables_hold_no_plaintext(spark, tmp_path, monkeypatch):
    from conftest import SMALL

    from veilframe.plans import sealing_queries as Q

    monkeypatch.setattr(Q, "scratch_path", lambda _, name: str(tmp_path / name))
    assert all(r["ok_new"] and r["fails_old"] for r in Q.q_reseal_roundtrip(spark, SMALL).collect())
    written = [spark.read.parquet(str(p)).columns for p in tmp_path.iterdir()]
    assert len(written) == 2 and all(c == ["conv_id", "turn", "org_id", "prompt_ciphertext"] for c in written)


def test_lineage_long_chain_cycle_and_orphans(spark):
    from veilframe.operators import keys as K

    chain = spark.range(0, 150).selectExpr("id AS key_id", "CASE WHEN id > 0 THEN id - 1 END AS rotated_from_id")
    rest = spark.createDataFrame([(1000, 1001), (1001, 1000), (1002, 1001), (2000, 99999), (3000, None)], "key_id long, rotated_from_id long")
    got = {r["key_id"]: (r["root_id"], r["depth"]) for r in K.key_lineage(spark, chain.unionByName(rest)).collect()}
    assert all(got[i] == (0, i) for i in range(150))
    assert got[1000] == got[1001] == got[1002] == (None, None)
    assert got[2000] == (2000, 0) and got[3000] == (3000, 0) and len(got) == 155
    assert K.key_lineage(spark, chain.limit(0)).count() == 0


def test_second_rotation_of_a_key_conflicts(spark):
    from veilframe.operators import keys as K

    keys = spark.sql("SELECT 1L AS key_id, 5L AS org_id, 'a' AS name, CAST(NULL AS TIMESTAMP_NTZ) AS grace_expires_at, 3 AS rate_limit_per_hour")
    events = spark.sql("SELECT * FROM VALUES (1L, 5L, TIMESTAMP_NTZ '2020-01-02'), (1L, 5L, TIMESTAMP_NTZ '2020-01-01'),"
                       " (1L, 6L, TIMESTAMP_NTZ '2019-01-01'), (1L, 5L, TIMESTAMP_NTZ '2020-01-01'), (9L, 5L, TIMESTAMP_NTZ '2020-01-01')"
                       " AS t(key_id, org_id, ts)")
    rows = K.apply_rotations(keys, events, 100).collect()
    assert sorted(r["status"] for r in rows) == [201, 404, 404, 409, 409]
    assert [str(r["grace_expires_at"]) for r in rows if r["status"] == 201] == ["2020-01-02 00:00:00"]


def test_context_reads_whole_tokens(spark):
    from veilframe.functions.spans import context_tokens

    text = "secret " + "x" * 500 + " a, b"
    df = spark.createDataFrame([(text,), ("",), ("One two three four five six 9",)], "t string")
    got = [r[0] for r in df.select(context_tokens(F.col("t"), F.length("t") - 1, 5)).collect()]
    assert got == [["secret", "x" * 500, "a"], [], ["two", "three", "four", "five", "six"]]
